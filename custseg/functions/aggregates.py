"""Aggregates with R's default NA behaviour.

R's ``sum/min/max/mean`` without ``na.rm`` return NA as soon as one input is
NA, whereas SQL aggregates skip NULLs.  ``na_policy='propagate'`` reproduces R;
``'skip'`` is plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guard(x: Column, agg: Column, na_policy: str) -> Column:
    if na_policy == "skip":
        return agg
    if na_policy != "propagate":
        raise ValueError(f"na_policy must be 'propagate' or 'skip', got {na_policy!r}")
    return F.when(F.count(x) < F.count(F.lit(1)), F.lit(None)).otherwise(agg)


def na_sum(c: Column | str, na_policy: str = "propagate") -> Column:
    x = _col(c)
    return _guard(x, F.sum(x), na_policy)


def na_min(c: Column | str, na_policy: str = "propagate") -> Column:
    x = _col(c)
    return _guard(x, F.min(x), na_policy)


def na_max(c: Column | str, na_policy: str = "propagate") -> Column:
    x = _col(c)
    return _guard(x, F.max(x), na_policy)


def na_mean(c: Column | str, na_policy: str = "propagate") -> Column:
    x = _col(c)
    return _guard(x, F.avg(x.cast("double")), na_policy)
