"""Integer ``yyyymmdd`` date keys and day windows."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365  # the reference counts a year as 365 days


def parse_date_key(key: Column | str) -> Column:
    """``yyyymmdd`` integer -> DATE; a malformed key gives NULL (never an error)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.try_to_date(k.cast("string"), "yyyyMMdd")


def date_key(d: Column | str) -> Column:
    """DATE -> ``yyyymmdd`` integer key."""
    c = F.col(d) if isinstance(d, str) else d
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def window_start(as_of: str | _dt.date, years: int) -> _dt.date:
    """Lower bound (inclusive) of an ``as_of - 365*years`` day window."""
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return as_of - _dt.timedelta(days=DAYS_PER_YEAR * years)
