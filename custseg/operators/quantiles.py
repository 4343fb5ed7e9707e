"""Exact, distributed ``ntile``, ranks and quantiles.

``ntile(4) OVER (ORDER BY v, key)`` with a global window moves every row into a
single partition.  Here the buckets of all metrics come from their *borders*:

1. a histogram, one row per (metric, distinct value) -- days and counts have few --
   is the only thing that is range-partitioned and sorted, and running sums
   over its partitions (offsets: one row per metric and partition) give the value in
   which each bucket ends;
2. only customers that hold such a value, and only where the bucket ends inside
   it, need the order of the keys: the distributed rank finds the key of the
   border row among them, however many they are;
3. a border is a pair (value, key), at most ``buckets - 1`` a metric; every row's
   bucket is a comparison with them, a projection without shuffle or join.

The distributed rank (``global_rank``) range-partitions rows on
``(part, value, key)``: the key makes the sort key unique, so even a value shared by
a third of all rows is split.  Inside a sorted partition the row index comes from
``monotonically_increasing_id``; the laid-out rows are written once, as ids belong to
one layout, and a table with one row per (part, partition) gives the offsets.

NULL values are not ranked and get a NULL bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custseg.session import written

_ROW_BITS = 33  # documented layout of monotonically_increasing_id


@dataclass(frozen=True)
class TileSpec:
    value: str          # column to rank
    out: str            # output column
    ascending: bool = True


def ntile_bucket(rank: Column, n: Column, buckets: int) -> Column:
    """SQL NTILE bucket of 1-based ``rank`` among ``n`` rows."""
    q = F.floor(n / buckets)
    r = n - q * buckets
    big = r * (q + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((rank - 1 - big) / q) + 1).cast("int")


def laid_out(df: DataFrame, part_cols: list[str], value: str, tiebreak: str) -> DataFrame:
    """Rows range-partitioned and sorted, with partition ``_p`` and place ``_i``."""
    order = [*part_cols, value, tiebreak]
    base = df.filter(F.col(value).isNotNull())
    return (base.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_id", F.monotonically_increasing_id())
            .withColumn("_p", F.shiftright("_id", _ROW_BITS))
            .withColumn("_i", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
            .drop("_id"))


def global_rank(df: DataFrame, part_cols: list[str], value: str, tiebreak: str) -> DataFrame:
    """``df`` (non-NULL ``value`` rows) plus ``_rank`` (1-based position within
    ``part_cols`` ordered by ``value, tiebreak``) and ``_n`` (rows of the part).

    ``tiebreak`` should be (nearly) unique -- a customer key -- so that the
    range partitioner can split even a value shared by a third of all rows.
    The per-(part, partition) offsets table is bounded by #parts × #partitions
    and is broadcast.
    """
    ranged = written(laid_out(df, part_cols, value, tiebreak), "rank")
    per_part = ranged.groupBy(*part_cols, "_p").agg(F.count(F.lit(1)).alias("_c"),
                                                    F.min("_i").alias("_start"))
    w = Window.partitionBy(*part_cols).orderBy("_p")
    whole = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy()
    offsets = per_part.select(
        *part_cols, "_p", "_start",
        F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_c").over(whole).alias("_n"))
    out = ranged.join(F.broadcast(offsets), [*part_cols, "_p"])
    return out.withColumn("_rank", F.col("_off") + (F.col("_i") - F.col("_start")) + 1) \
              .drop("_p", "_i", "_off", "_start")


def value_histogram(df: DataFrame, specs: list[TileSpec]) -> DataFrame:
    """``_m, _v, _w``: rows per metric (its place in ``specs``) and value, values of
    descending metrics negated."""
    signed = df.select(*[_signed(s).alias(f"m{i}") for i, s in enumerate(specs)])
    return signed.select(F.lit(0).alias("_k"), "*").unpivot("_k", [f"m{i}" for i in range(len(specs))], "_name", "_v") \
        .filter("_v is not null").groupBy(F.substring("_name", 2, 3).cast("int").alias("_m"), "_v") \
        .agg(F.count(F.lit(1)).alias("_w"))


def _signed(s: TileSpec) -> Column:
    return F.col(s.value).cast("double") * (1.0 if s.ascending else -1.0)


def borders(df: DataFrame, key: str, specs: list[TileSpec], buckets: int = 4) -> list[list[tuple]]:
    """Per spec the (value, key) of the last row of buckets 1..buckets-1; the key is
    None where a bucket ends with the last row of its value.  Values are signed."""
    hist = written(value_histogram(df, specs).repartitionByRange("_m", "_v").sortWithinPartitions("_m", "_v")
                   .withColumn("_p", F.shiftright(F.monotonically_increasing_id(), _ROW_BITS)), "value-histogram")
    # one row per (metric, partition)
    parts = hist.groupBy("_m", "_p").agg(F.sum("_w").alias("_c"))
    w = Window.partitionBy("_m").orderBy("_p")
    places = parts.select("_m", "_p", (F.sum("_c").over(w) - F.col("_c")).alias("_off"), "_c",
                          F.sum("_c").over(Window.partitionBy("_m")).alias("_n"))
    base, extra = F.floor(F.col("_n") / buckets), F.col("_n") % buckets
    ends = F.array(*[F.struct(F.lit(j).alias("j"), (base * j + F.least(extra, F.lit(j))).cast("long").alias("r"))
                     for j in range(1, buckets)])
    wanted = places.select("*", F.explode(ends).alias("_e")).filter(
        (F.col("_e.r") > F.col("_off")) & (F.col("_e.r") <= F.col("_off") + F.col("_c"))) \
        .select("_m", "_p", "_off", F.col("_e.j").alias("_j"), F.col("_e.r").alias("_r"))
    # running sums inside the at most (buckets - 1) x metrics partitions that hold a border
    inside = Window.partitionBy("_m", "_p", "_j").orderBy("_v")
    found = hist.join(F.broadcast(wanted), ["_m", "_p"]).withColumn(
        "_upto", F.col("_off") + F.sum("_w").over(inside)).filter(
        (F.col("_upto") >= F.col("_r")) & (F.col("_upto") - F.col("_w") < F.col("_r")))
    out: list[list[tuple]] = [[] for _ in specs]
    inner = []
    for r in found.select("_m", "_j", "_v", "_w", (F.col("_r") - F.col("_upto") + F.col("_w")).alias("_at")) \
            .orderBy("_m", "_j").collect():              # (buckets - 1) x metrics rows
        out[r["_m"]].append((r["_v"], None))
        if r["_at"] < r["_w"]:
            inner.append((r["_m"], len(out[r["_m"]]) - 1, r["_v"], r["_at"]))
    if inner:
        values = {m: [] for m, *_ in inner}
        for m, _, v, _ in inner:
            values[m] += [v] if v not in values[m] else []
        tagged = F.array_compact(F.array(*[
            F.when(_signed(specs[m]) == F.lit(v), F.lit(m * buckets + i)) for m in values for i, v in enumerate(values[m])]))
        holders = df.select(F.col(key).alias("_k"), F.explode(tagged).alias("_g"))
        ranks = global_rank(holders, ["_g"], "_k", "_k")
        pick = F.lit(False)
        for m, _, v, at in inner:
            pick = pick | ((F.col("_g") == m * buckets + values[m].index(v)) & (F.col("_rank") == at))
        keys = {(r["_g"], r["_rank"]): r["_k"] for r in ranks.filter(pick).collect()}
        for m, place, v, at in inner:
            out[m][place] = (v, keys.get((m * buckets + values[m].index(v), at)))
    return out


def bucket_of(spec: TileSpec, ends: list[tuple], key: str) -> Column:
    """Bucket of a row by comparison with the borders (value, key)."""
    x, k = _signed(spec), F.col(key)
    bucket = F.lit(1)
    for v, last in ends:
        within = (x <= F.lit(v)) if last is None else \
            (x < F.lit(v)) | ((x == F.lit(v)) & F.coalesce(k <= F.lit(last), F.lit(False)))
        bucket = bucket + F.when(within, 0).otherwise(1)
    return F.when(x.isNotNull(), bucket).cast("int")


def exact_ntile(df: DataFrame, key: str, specs: list[TileSpec], buckets: int = 4,
                partitions: int | None = None) -> DataFrame:
    """``key`` plus one bucket column per spec, for every key with at least one
    non-NULL value (see ``with_ntiles`` to keep all rows of ``df``)."""
    if partitions:
        df = df.repartition(partitions)
    some = F.lit(False)
    for s in specs:
        some = some | F.col(s.value).isNotNull()
    return with_ntiles(df.filter(some), key, specs, buckets).select(key, *[s.out for s in specs])


def exact_quantiles(df: DataFrame, group_cols: list[str], value: str, tiebreak: str,
                    probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (R type 7 / ``percentile``):
    h = (n-1)p + 1, q = x[floor h] + (h - floor h)(x[ceil h] - x[floor h]).

    Unlike ``percentile`` (which holds every distinct value of a group in one
    task), only the <= 2·len(probs) order statistics of each group survive
    the distributed rank.  Output ``group…, n, q0, q1, …``.
    """
    r = global_rank(df.select(*group_cols, value, tiebreak), group_cols, value, tiebreak)
    n1 = F.col("_n") - 1
    keep = None
    aggs = []
    for j, p in enumerate(probs):
        lo = F.floor(n1 * p) + 1
        hi = F.ceil(n1 * p) + 1
        cond = (F.col("_rank") == lo) | (F.col("_rank") == hi)
        keep = cond if keep is None else keep | cond
        aggs += [F.max(F.when(F.col("_rank") == lo, F.col(value))).alias(f"_lo{j}"),
                 F.max(F.when(F.col("_rank") == hi, F.col(value))).alias(f"_hi{j}")]
    picked = r.filter(keep).groupBy(*group_cols, "_n").agg(*aggs)
    out = []
    for j, p in enumerate(probs):
        h = (F.col("_n") - 1) * p + 1
        frac = h - F.floor(h)
        out.append((F.col(f"_lo{j}") + frac * (F.col(f"_hi{j}") - F.col(f"_lo{j}"))).alias(f"q{j}"))
    return picked.select(*group_cols, F.col("_n").alias("n"), *out)


def with_ntiles(df: DataFrame, key: str, specs: list[TileSpec], buckets: int = 4) -> DataFrame:
    """``df`` with the bucket columns appended (NULL where the value is NULL).

    ``df`` must have one row per ``key``, and no NULL key where a value is tied at a
    bucket's end.  The borders are found first; the columns are a projection."""
    ends = borders(df, key, specs, buckets)
    return df.select("*", *[bucket_of(s, e, key).alias(s.out) for s, e in zip(specs, ends)])


def exact_sample(df: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """Exactly ``round(fraction · n)`` rows (like ``sample_frac``), chosen by a
    seeded hash of the key: the rows with the smallest hashes.  The cut is a
    distributed rank -- no ``orderBy().limit()`` that would pull the sample
    into one task."""
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    r = global_rank(h.withColumn("_g", F.lit(0)), ["_g"], "_h", key)
    m = F.round(F.col("_n") * F.lit(float(fraction)))
    return r.filter(F.col("_rank") <= m).drop("_h", "_g", "_rank", "_n")
