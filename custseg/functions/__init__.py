"""Column-expression helpers (all JVM-side, whole-stage-codegen friendly)."""

from custseg.functions.dates import date_key, parse_date_key, window_start
from custseg.functions.aggregates import na_max, na_min, na_mean, na_sum
from custseg.functions.power import yeo_johnson

__all__ = [
    "date_key", "parse_date_key", "window_start",
    "na_max", "na_min", "na_mean", "na_sum",
    "yeo_johnson",
]
