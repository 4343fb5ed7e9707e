"""Per-customer Recency / Frequency / Monetary / Tenure (/ Streaming).

The reference builds each metric with its own group-by and glues them with
``reduce(left_join)``; all four come from the same order lines and have the
same key set, so here they are ONE ``groupBy(Customer_Key).agg`` (one shuffle
of the order lines, partial aggregation map-side).  The reference date
(``max(Date)`` of the frame) is a scalar subquery over the per-customer maxima,
not a second pass over the order lines.
"""

from __future__ import annotations

import datetime as _dt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.functions.aggregates import na_max, na_min, na_sum
from custseg.functions.dates import parse_date_key

KEY = "Customer_Key"
RFMT = ["RecencyDays", "Frequency", "Monetary", "Tenure"]
RFMTS = RFMT + ["Streaming"]
RFM = ["RecencyDays", "Frequency", "Monetary"]


def order_lines(orders: DataFrame) -> DataFrame:
    """Customer, order day (from the integer key) and money of every order row."""
    return orders.select(
        F.col(KEY),
        parse_date_key("DateOrdered_Key").alias("Date"),
        F.col("`5_DB2`").alias("DB2"),
    )


def customer_aggregates(lines: DataFrame, na_policy: str = "propagate") -> DataFrame:
    """One pass: last/first order day, order count and money per customer."""
    return lines.groupBy(KEY).agg(
        na_max("Date", na_policy).alias("last_date"),
        na_min("Date", na_policy).alias("first_date"),
        F.count(F.lit(1)).alias("Frequency"),
        na_sum("DB2", na_policy).alias("Monetary_dec"),
    )


def reference_date(lines: DataFrame, na_policy: str = "propagate") -> DataFrame:
    """One-row ``last_date`` = max order day of the frame."""
    return lines.agg(na_max("Date", na_policy).alias("last_date"))


def _ref_column(agg: DataFrame, reference: str | _dt.date, na_policy: str) -> Column:
    if isinstance(reference, _dt.date):
        return F.lit(reference)
    if reference != "frame":
        raise ValueError("reference must be 'frame' or a date")
    # max over the per-customer maxima == max over the lines (NULL propagates)
    return agg.select(na_max("last_date", na_policy)).scalar()


def rfmt_features(lines: DataFrame, reference: str | _dt.date = "frame",
                  na_policy: str = "propagate", metrics: list[str] | None = None
                  ) -> DataFrame:
    """``Customer_Key, RecencyDays, Frequency, Monetary, Tenure``.

    Recency/Tenure are whole days before the reference date (int); Monetary is
    summed exactly as decimal and returned as double.
    """
    metrics = metrics or RFMT
    agg = customer_aggregates(lines, na_policy)
    if not isinstance(reference, _dt.date):
        # the reference date is read from the per-customer rows and the rows are
        # used again for the features: keep them (customer grain, far smaller
        # than the order lines) so the order fact is scanned once.  Lost blocks
        # are recomputed from lineage.
        agg = agg.persist(StorageLevel.MEMORY_AND_DISK)
    ref = _ref_column(agg, reference, na_policy)
    cols = {
        "RecencyDays": F.datediff(ref, F.col("last_date")).cast("int"),
        "Frequency": F.col("Frequency").cast("bigint"),
        "Monetary": F.col("Monetary_dec").cast("double"),
        "Tenure": F.datediff(ref, F.col("first_date")).cast("int"),
    }
    return agg.select(KEY, *[cols[m].alias(m) for m in metrics])


def rfmts_features(lines: DataFrame, streaming: DataFrame,
                   segments: DataFrame | None = None, segment: str | None = "BTC",
                   reference: str = "cohort", na_policy: str = "propagate",
                   metrics: list[str] | None = None) -> DataFrame:
    """RFMT plus ``Streaming`` (the reader count ``n``), inner-joined on the key.

    ``reference='cohort'``: restrict the order lines to the segment first, so the
    reference date is the max of the cohort (``%in%`` = left-semi join).
    ``reference='all'``: features over all lines, then join the segment table and
    keep ``segment`` (left join + filter == inner join; a customer listed twice
    with that segment would appear twice, as in the reference).
    With ``segment=None`` no segment restriction is applied.
    ``metrics`` selects which order metrics to build (RFM for the cohort
    script, RFMT otherwise); Streaming is added when ``streaming`` is given.
    """
    metrics = metrics or RFMT
    seg = None
    if segment is not None:
        if segments is None:
            raise ValueError("segments table needed to restrict to a segment")
        seg = segments.filter(F.col("Segment") == segment).select(KEY)
    stream = None
    if streaming is not None:
        stream = streaming.select(KEY, F.col("n").alias("Streaming"))
    if seg is not None and reference == "cohort":
        lines = lines.join(seg, KEY, "left_semi")
        if stream is not None:
            stream = stream.join(seg, KEY, "left_semi")
        feats = rfmt_features(lines, "frame", na_policy, metrics)
    elif reference in ("cohort", "all"):
        feats = rfmt_features(lines, "frame", na_policy, metrics)
        if seg is not None:
            feats = feats.join(seg, KEY, "inner")
    else:
        feats = rfmt_features(lines, reference, na_policy, metrics)
        if seg is not None:
            feats = feats.join(seg, KEY, "inner")
    if stream is not None:
        feats = feats.join(stream, KEY, "inner")
    return feats


def features_by_segment(features: DataFrame, segments: DataFrame) -> DataFrame:
    """Attach ``Segment`` to customer features (one row per customer x segment)."""
    return features.join(segments.select(KEY, "Segment").filter(F.col("Segment").isNotNull()),
                         KEY, "inner")


def order_aggregates_premium(src, years: int, as_of, require_active: bool = True,
                             customers: DataFrame | None = None,
                             na_policy: str = "propagate") -> DataFrame:
    """Per-customer aggregates of the premium order extract, aggregated
    BEFORE the premium join.

    Equivalent to ``customer_aggregates(order_lines(orders_extract(...)))``:
    the inner join with the premium table multiplies every order of a key by
    the key's multiplicity ``m`` in that table, so Frequency and Monetary are
    scaled by ``m`` while first/last day are unchanged.  Aggregating first lets
    the partial aggregation collapse the order lines map-side (one row per
    customer and task, whatever the skew of a key), and the join then runs at
    customer grain instead of order grain.  ``customers`` (key column only)
    optionally restricts the cohort (left semi join on the aggregate).
    """
    from custseg.sources import extracts
    o = extracts.valid_orders(src, as_of, years).select(
        F.col(KEY), parse_date_key("DateOrdered_Key").alias("Date"),
        F.col("`5_DB2`").alias("DB2"))
    agg = o.groupBy(KEY).agg(
        na_max("Date", na_policy).alias("last_date"),
        na_min("Date", na_policy).alias("first_date"),
        F.count(F.lit(1)).alias("_n"),
        na_sum("DB2", na_policy).alias("_m"))
    if customers is not None:
        # restricting customers commutes with the per-customer aggregation, so
        # it runs at customer grain on the aggregate's key partitioning instead
        # of shuffling every order line for the semi join
        agg = agg.join(customers, KEY, "left_semi")
    return times_premium(agg, src, require_active)


def times_premium(agg: DataFrame, src, require_active: bool = True) -> DataFrame:
    """Aggregates ``_n, _m`` of premium customers times the key's rows in that table."""
    prem = src.premium_active
    if require_active:
        prem = prem.filter(F.col("IsActive") == 1)
    mult = prem.groupBy(KEY).agg(F.count(F.lit(1)).alias("_mult"))
    return agg.join(mult, KEY, "inner").select(
        KEY, "last_date", "first_date",
        (F.col("_n") * F.col("_mult")).alias("Frequency"),
        (F.col("_m") * F.col("_mult")).alias("Monetary_dec"))


def order_aggregates_non_premium(src, years: int, as_of,
                                 na_policy: str = "propagate") -> DataFrame:
    """Per-customer aggregates of the orders of customers absent from the
    premium table: aggregate first, then the anti join at customer grain."""
    from custseg.sources import extracts
    o = extracts.valid_orders(src, as_of, years).select(
        F.col(KEY), parse_date_key("DateOrdered_Key").alias("Date"),
        F.col("`5_DB2`").alias("DB2"))
    agg = o.groupBy(KEY).agg(
        na_max("Date", na_policy).alias("last_date"),
        na_min("Date", na_policy).alias("first_date"),
        F.count(F.lit(1)).alias("Frequency"),
        na_sum("DB2", na_policy).alias("Monetary_dec"))
    return agg.join(src.premium_active.select(KEY), KEY, "left_anti")


def features_from_aggregates(agg: DataFrame, reference: str | _dt.date = "frame",
                             na_policy: str = "propagate", metrics: list[str] | None = None,
                             keep: bool = True) -> DataFrame:
    """RFMT columns from per-customer aggregates (see ``rfmt_features``).  ``keep=False``
    reads ``agg`` twice instead of persisting it (and losing its partitioning)."""
    metrics = metrics or RFMT
    if keep and not isinstance(reference, _dt.date):
        agg = agg.persist(StorageLevel.MEMORY_AND_DISK)
    ref = _ref_column(agg, reference, na_policy)
    cols = {
        "RecencyDays": F.datediff(ref, F.col("last_date")).cast("int"),
        "Frequency": F.col("Frequency").cast("bigint"),
        "Monetary": F.col("Monetary_dec").cast("double"),
        "Tenure": F.datediff(ref, F.col("first_date")).cast("int"),
    }
    return agg.select(KEY, *[cols[m].alias(m) for m in metrics])


def premium_features(src, years: int, as_of, segment: str | None = None,
                     reference: str = "cohort", streaming: DataFrame | None = None,
                     segments: DataFrame | None = None, require_active: bool = True,
                     metrics: list[str] | None = None, na_policy: str = "propagate"
                     ) -> DataFrame:
    """The features of the reference's scripts straight from the sources,
    with the aggregation pushed below the premium join.

    ``segment`` + ``reference='cohort'``: orders restricted to the segment
    before aggregating (reference date = max of the cohort);
    ``reference='all'``: features over all premium customers, then inner join
    with the segment.  ``streaming`` (``Customer_Key, n``) adds Streaming.
    """
    metrics = metrics or RFMT
    seg = None
    if segment is not None:
        seg = segments.filter(F.col("Segment") == segment).select(KEY)
    cohort = seg if (seg is not None and reference == "cohort") else None
    agg = order_aggregates_premium(src, years, as_of, require_active, cohort, na_policy)
    ref = "frame" if reference in ("cohort", "all") else reference
    feats = features_from_aggregates(agg, ref, na_policy, metrics)
    if seg is not None and reference != "cohort":
        feats = feats.join(seg, KEY, "inner")
    if streaming is not None:
        stream = streaming.select(KEY, F.col("n").alias("Streaming"))
        if cohort is not None:
            stream = stream.join(cohort, KEY, "left_semi")
        feats = feats.join(stream, KEY, "inner")
    return feats
