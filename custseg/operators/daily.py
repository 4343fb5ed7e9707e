"""Rolling features from a mergeable state per (customer, day).

A daily run over a 365-day window reads 365 days of orders of which 364 were read the
day before.  The state keeps, per order day and customer, the number of orders,
their money and the number of NULL amounts; these merge by addition, so

* ``build``    aggregates the days of a window once, a partition folder per day;
* ``refresh``  reads only the days after the last one held (the day is a pushed filter
  of the fact scan) and writes their folders; ``again`` names older days that
  changed -- late or cancelled orders -- and are aggregated anew;
* ``features`` merges the days inside the window; days that left it are not read
  (partition filter) and need not be deleted.

The result equals the features of the full extract.  A re-run replaces the folders
of its own days only, so a failed run is repeated as it is.  A day without valid
orders has no folder; a malformed day key is a day of its own and makes the
customer's dates NULL, as in the full extract.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.functions.aggregates import na_max, na_min
from custseg.functions.dates import parse_date_key, window_start
from custseg.operators import features as feat
from custseg.sources.extracts import UNKNOWN_KEY

KEY = "Customer_Key"


def _day_key(day: _dt.date) -> int:
    return int(day.strftime("%Y%m%d"))


def orders_of_days(src, after: int | None = None, until: int | None = None, days: list[int] | None = None) -> DataFrame:
    """Known, uncancelled orders with ``after < day key <= until`` or of the given days."""
    o = src.order_fact.filter((F.col(KEY) != UNKNOWN_KEY) & (F.col("DateCancelled_Key") == UNKNOWN_KEY))
    day = F.col("DateOrdered_Key")
    parsed = "Date" in o.columns        # a stored day reaches the scan, the key may be derived
    if days is not None:
        return o.filter(day.isin(*days))
    if after is not None:
        o = o.filter((day > after) & (F.col("Date") >= F.lit(_dt.datetime.strptime(str(after), "%Y%m%d").date()))
                     if parsed else day > after)
    return o.filter(day <= until) if until is not None else o


def state_of(orders: DataFrame) -> DataFrame:
    """``Customer_Key, day, n, money, nulls``: one row per customer and order day."""
    return orders.groupBy(KEY, F.col("DateOrdered_Key").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("`5_DB2`").alias("money"),
        F.count_if(F.col("`5_DB2`").isNull()).alias("nulls"))


def _put(state: DataFrame, path: str) -> None:
    state.select(KEY, "n", "money", "nulls", "day").repartition("day").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def build(path: str, src, as_of: _dt.date, years: int, until: _dt.date | None = None) -> None:
    """The state of the window ``as_of`` - 365 * ``years`` days, up to ``until``."""
    first = _day_key(window_start(as_of, years) - _dt.timedelta(days=1))
    _put(state_of(orders_of_days(src, first, _day_key(until) if until else None)), path)


def last_day(spark, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("day")).collect()[0][0]


def refresh(path: str, src, again: list[int] | None = None) -> None:
    """Adds the days after the last one held, and aggregates the days ``again`` anew."""
    spark = src.order_fact.sparkSession
    held = last_day(spark, path)
    if again:
        _put(state_of(orders_of_days(src, days=again)), path)
    _put(state_of(orders_of_days(src, held)), path)


def features(path: str, src, as_of: _dt.date, years: int, require_active: bool = True,
             metrics: list[str] | None = None) -> DataFrame:
    """The premium features of the window ending at ``as_of``, merged from the state."""
    first = _day_key(window_start(as_of, years))
    state = src.order_fact.sparkSession.read.parquet(path).filter(F.col("day") >= first)
    date = parse_date_key("day")
    agg = state.withColumn("_date", date).groupBy(KEY).agg(
        na_max("_date").alias("last_date"), na_min("_date").alias("first_date"), F.sum("n").alias("_n"),
        F.when(F.sum("nulls") == 0, F.sum("money")).alias("_m"))
    return feat.features_from_aggregates(feat.times_premium(agg, src, require_active), "frame", metrics=metrics)
