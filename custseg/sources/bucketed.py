"""Facts and dimensions as tables bucketed on ``Customer_Key``.

The feature scripts join facts, premium, reader and segment tables on one key, every
run anew.  ``build`` pays that shuffle once: it writes each relation bucketed and
sorted on the key, so a later run groups and joins bucket by bucket without an
Exchange (tested on the plan).

The facts are not stored row by row: orders are the (customer, day) state of
``operators.daily`` and reads are counts per (customer, day), both combined map-side.
A customer thus has at most one row a day, and one that holds a third of all orders
does not make a bucket that one task must read alone.

Tables (``prefix`` + name, external files under ``path``): ``_orders`` Customer_Key,
day, n, money, nulls; ``_reads`` Customer_Key, day, n; ``_premium`` Customer_Key,
IsActive (rows as they are: a repeated key multiplies, as in the plain join);
``_subscribed`` Customer_Key; ``_segments`` Customer_Key, Segment.

Cases: NULL keys join nothing; NULL money makes a customer's Monetary NULL; a malformed
day key is a day of its own and makes the dates NULL, as in the plain path.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.functions.aggregates import na_max, na_min
from custseg.functions.dates import parse_date_key, window_start
from custseg.operators import daily
from custseg.operators import features as feat
from custseg.sources.relations import Sources

KEY = "Customer_Key"
BUCKETS = 64          # a bucket should fit an executor's memory comfortably: raise it with the data


def _save(df: DataFrame, table: str, path: str, buckets: int) -> None:
    # the write's own hash, so each bucket is one file
    df.repartition(buckets, KEY).write.format("parquet").mode("overwrite").option("path", f"{path}/{table}") \
        .bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(table)


def reads_of_days(src: Sources) -> DataFrame:
    """``Customer_Key, day, n``: streamed premium reads."""
    return src.reader_fact.filter((F.col("Streaming_Key") == 1) & (F.col("IsBucketRead_Key") == 1)
                                  & (F.col("Premium_Key") == 1)) \
        .groupBy(KEY, F.col("Date_Key").alias("day")).agg(F.count(KEY).alias("n"))


def build(src: Sources, prefix: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes the five tables; all with the same number of buckets."""
    for name, df in {
            "orders": daily.state_of(daily.orders_of_days(src)), "reads": reads_of_days(src),
            "premium": src.premium_active.select(KEY, "IsActive"),
            "subscribed": src.premium_subscribed.select(KEY).distinct(),
            "segments": src.cltv_input.select(KEY, "Segment").distinct()}.items():
        _save(df, f"{prefix}_{name}", path, buckets)


def _day_key(day: _dt.date) -> int:
    return int(day.strftime("%Y%m%d"))


def streaming_counts(spark: SparkSession, prefix: str, as_of: _dt.date, years: int = 1) -> DataFrame:
    """``Customer_Key, n`` per subscriber; 0 without reads."""
    n = spark.table(f"{prefix}_reads").filter(F.col("day") >= _day_key(window_start(as_of, years))) \
        .groupBy(KEY).agg(F.sum("n").alias("n"))
    return spark.table(f"{prefix}_subscribed").join(n, KEY, "left").select(
        KEY, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def premium_features(spark: SparkSession, prefix: str, as_of: _dt.date, years: int, segment: str | None = None,
                     reader_as_of: _dt.date | None = None, require_active: bool = True,
                     metrics: list[str] | None = None) -> DataFrame:
    """``features.premium_features`` of the cohort from the bucketed tables; with
    ``reader_as_of`` also Streaming."""
    state = spark.table(f"{prefix}_orders").filter(F.col("day") >= _day_key(window_start(as_of, years)))
    date = parse_date_key("day")
    agg = state.withColumn("_date", date).groupBy(KEY).agg(
        na_max("_date").alias("last_date"), na_min("_date").alias("first_date"), F.sum("n").alias("_n"),
        F.when(F.sum("nulls") == 0, F.sum("money")).alias("_m"))
    stream = None
    if reader_as_of is not None:
        stream = streaming_counts(spark, prefix, reader_as_of).select(KEY, F.col("n").alias("Streaming"))
    if segment is not None:
        cohort = spark.table(f"{prefix}_segments").filter(F.col("Segment") == segment).select(KEY)
        agg = agg.join(cohort, KEY, "left_semi")
        stream = stream.join(cohort, KEY, "left_semi") if stream is not None else None
    premium = spark.table(f"{prefix}_premium")
    src = Sources(state, premium, premium, state, premium, premium)      # times_premium reads premium_active alone
    out = feat.features_from_aggregates(feat.times_premium(agg, src, require_active), "frame", metrics=metrics,
                                        keep=False)      # the buckets are read twice, nothing is shuffled
    return out if stream is None else out.join(stream, KEY, "inner")
