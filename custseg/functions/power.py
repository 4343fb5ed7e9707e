"""Yeo-Johnson power transform as a column expression.

x >= 0: ((x+1)^lam - 1)/lam, or ln(x+1) when |lam| < eps
x <  0: -((1-x)^(2-lam) - 1)/(2-lam), or -ln(1-x) when |lam-2| < eps
A NULL lambda means "leave the column untransformed".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the transform (must equal the reference's recipe step)
YJ_EPS = 0.001          # |lambda| (or |2-lambda|) below this uses the log limit
YJ_LIMITS = (-5.0, 5.0)  # lambda search interval
YJ_MIN_UNIQUE = 5        # fewer distinct values -> no transform


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def yeo_johnson(x: Column | str, lam: Column | float | None) -> Column:
    x = _col(x).cast("double")
    if lam is None:
        return x
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    pos = F.when(F.abs(lam) < YJ_EPS, F.log1p(x)).otherwise(
        (F.pow(x + 1.0, lam) - 1.0) / lam)
    neg = F.when(F.abs(lam - 2.0) < YJ_EPS, -F.log1p(-x)).otherwise(
        -(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(lam.isNull(), x).when(x >= 0, pos).otherwise(neg)
