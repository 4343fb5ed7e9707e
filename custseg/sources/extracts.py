"""The warehouse extracts of the reference, as lazy DataFrame plans.

All predicates are plain column comparisons so that Catalyst pushes them into
the scan.  The premium dimension is joined without a hint: Spark (and AQE at
runtime) broadcasts it only while it is below ``autoBroadcastJoinThreshold``
and falls back to a sort-merge join on ``Customer_Key`` beyond that.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.functions.dates import date_key, window_start
from custseg.sources.relations import Sources

UNKNOWN_KEY = -1      # fixed sentinel: unknown customer / not cancelled


def _day_window(df: DataFrame, key_col: str, as_of, years: int) -> DataFrame:
    lo = window_start(as_of, years)
    if "Date" in df.columns:
        return df.filter(F.col("Date") >= F.lit(lo))
    return df.filter(F.col(key_col) >= F.lit(int(lo.strftime("%Y%m%d"))))


def valid_orders(src: Sources, as_of, years: int) -> DataFrame:
    """Known, uncancelled orders inside the day window (before any join)."""
    f = src.order_fact
    f = f.filter((F.col("Customer_Key") != UNKNOWN_KEY)
                 & (F.col("DateCancelled_Key") == UNKNOWN_KEY))
    return _day_window(f, "DateOrdered_Key", as_of, years)


def orders_extract(src: Sources, years: int, as_of: _dt.date,
                   require_active: bool = True) -> DataFrame:
    """Uncancelled orders of premium subscribers in the last ``365*years`` days.

    ``require_active=False`` is the variant without the ``IsActive = 1``
    predicate; it also returns ``IsActive`` like the reference's select list.
    A premium table with duplicate keys fans the orders out (inner-join
    semantics are kept; see ``duplicate_keys``).
    """
    prem = src.premium_active
    if require_active:
        prem = prem.filter(F.col("IsActive") == 1).select("Customer_Key")
    else:
        prem = prem.select("Customer_Key", "IsActive")
    out = valid_orders(src, as_of, years).join(prem, "Customer_Key", "inner")
    cols = ["DateOrdered_Key", "Customer_Key", "5_DB2"]
    if not require_active:
        cols.append("IsActive")
    return out.select(*cols)


def orders_non_premium(src: Sources, years: int, as_of: _dt.date) -> DataFrame:
    """Orders of customers absent from the premium table (left join + IS NULL
    written as the anti join it is)."""
    out = valid_orders(src, as_of, years).join(
        src.premium_active.select("Customer_Key"), "Customer_Key", "left_anti")
    return out.select("DateOrdered_Key", "Customer_Key", "5_DB2",
                      F.lit(None).cast("int").alias("IsActive"))


def streaming_counts(src: Sources, years: int, as_of: _dt.date) -> DataFrame:
    """Per premium subscriber: number of streamed (bucket-read, premium) reads
    in the window, 0 when none.  Output ``Customer_Key, n``.

    Both sides are grouped on ``Customer_Key`` so the left join reuses their
    hash partitioning (no third shuffle).
    """
    r = src.reader_fact.filter((F.col("Streaming_Key") == 1)
                               & (F.col("IsBucketRead_Key") == 1)
                               & (F.col("Premium_Key") == 1))
    r = _day_window(r, "Date_Key", as_of, years)
    counts = r.groupBy("Customer_Key").agg(F.count("Customer_Key").alias("n"))
    subs = src.premium_subscribed.select("Customer_Key").distinct()
    return (subs.join(counts, "Customer_Key", "left")
            .select("Customer_Key", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def segment_lookup(src: Sources, segment: str | None = None) -> DataFrame:
    """``SELECT DISTINCT Customer_Key, Segment`` (optionally one segment,
    filtered before the distinct so it reaches the scan)."""
    s = src.cltv_input.select("Customer_Key", "Segment")
    if segment is not None:
        s = s.filter(F.col("Segment") == segment)
    # hash on the key alone: it satisfies the distinct (key, Segment) and is
    # the partitioning every later join on Customer_Key needs (one shuffle
    # instead of one for the distinct and one more for the join)
    return s.repartition("Customer_Key").distinct()


def churn_labels(src: Sources) -> DataFrame:
    return src.churn_data.select("Customer_Key", "RFM_cluster")


def duplicate_keys(dim: DataFrame, key: str = "Customer_Key") -> DataFrame:
    """Keys that occur more than once in a dimension (they would fan out a join)."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


__all__ = ["orders_extract", "orders_non_premium", "streaming_counts", "segment_lookup",
           "churn_labels", "duplicate_keys", "date_key"]
