"""Single-partition reference answers for the tests (never used by the library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custseg.operators.quantiles import TileSpec


def window_ntile(df: DataFrame, key: str, specs: list[TileSpec], buckets: int = 4
                 ) -> DataFrame:
    """Single-partition reference implementation (tests only)."""
    out = df
    for s in specs:
        v = F.col(s.value)
        w = Window.orderBy(v.asc() if s.ascending else v.desc(), F.col(key).asc())
        nn = out.filter(v.isNotNull()).select(key, F.ntile(buckets).over(w).alias(s.out))
        out = out.join(nn, key, "left")
    return out.select(key, *[s.out for s in specs])
