"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Targets.  The sources in code-point order (null last) weigh 5, 2, 1, repeating,
and share ``budget`` times all words.  A target stops at ``cap`` times its
source's size and the excess is shared again by weight; the fixed point is
``target = min(cap * size, weight * level)`` with one level for all, found
exactly from running sums over the sources ordered by ``cap * size / weight``.

Balancing.  Among all rates w of the documents that meet the token constraints
``sum(size * w) = target`` of the sources, the one closest to "take every
document once" (least Kullback-Leibler divergence, tokens as base measure) is
exponentially tilted, ``w = exp(lambda[source])``.  Newton iterations solve the
convex dual ``size * exp(lambda) - target * lambda``; gradient and Hessian of a
source are sums over its documents, pre-aggregated once, so every iteration
runs on the table of sources, in place, without the driver.

Rounding.  The documents of a source are dealt into buckets of about
``BUCKET_ROWS`` by a hash, so a source with a third of all rows becomes many
groups.  Inside a bucket, from the largest document to the smallest, each takes
the whole number of copies next to its rate that brings the running total
nearest to the running target; the error left is about the smallest document.

Cases: null or blank text has size 0 and takes 0 words; a source without words
has target 0; null source is a source of its own; rows equal in id, text and
source are repeated rows, share one rate and are counted each; an empty table
gives an empty result.  Only id, text and source are read, so other columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custseg.llm.common import id_of, keyed, saved

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
BUCKET_ROWS = 256
NEWTON_STEPS = 60
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   cap: float = CAP) -> DataFrame:
    """``_source, _n, source_size, target, _rate`` from rows ``_source, _size, _m``."""
    per = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_m")).alias("source_size"),
                                       F.count(F.lit(1)).alias("_n"))
    # one row per source from here on
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.withColumn("_i", F.row_number().over(by_name) - 1) \
        .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                       (F.col("_i") % len(weights) + 1).cast("int"))) \
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size")) \
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    # sources before this one (by ratio) stop at their cap; the rest share by weight
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(budget))
             - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
                 F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level)
    # levels rise up to the first source that stays below its cap and fall after it:
    # that source's level holds for all that stay below theirs
    open_ = F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))
    per = per.withColumn("_tau", F.max(open_).over(everything))
    target = F.when(F.col("_tau").isNull(), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_w") * F.col("_tau")))
    return per.withColumn("target", target) \
        .withColumn("_rate", tilt(F.col("source_size"), F.col("target"), cap)) \
        .select("_source", "_n", "source_size", "target", "_rate")


def tilt(total: Column, target: Column, cap: float) -> Column:
    """exp(lambda) for the lambda that minimises ``total * exp(lambda) - target * lambda``."""
    def newton(lam, _):
        gradient = total * F.exp(lam) - target
        hessian = total * F.exp(lam)
        return lam - gradient / hessian
    lam = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), newton)
    return F.when((total > 0) & (target > 0), F.least(F.exp(lam), F.lit(float(cap)))).otherwise(0.0)


def _copies(items: Column, rate: Column) -> Column:
    """Copies of the items (largest first) so that the running total follows the running target."""
    def step(acc, x):
        weight = x["_size"] * x["_m"]
        want = acc["want"] + rate * weight
        ideal = F.round((want - acc["got"]) / weight).cast("int")
        n = F.when(weight > 0, F.greatest(F.floor(rate + 1e-9), F.least(F.ceil(rate - 1e-9), ideal)))
        n = F.coalesce(n, F.lit(0)).cast("int")
        return F.struct(want.alias("want"), (acc["got"] + n * weight).alias("got"),
                        F.concat(acc["out"], F.array(n)).alias("out"))
    start = F.struct(F.lit(0.0).alias("want"), F.lit(0).cast("long").alias("got"),
                     F.array().cast("array<int>").alias("out"))
    return F.aggregate(items, start, step, lambda a: a["out"])


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP,
                bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """One row per distinct (id, text, source): ``_d, _t, _source, _m`` (rows alike),
    ``size, source_size, target, copies, taken``."""
    source = F.col(f"`{source_col}`").cast("string")
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("_d"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_t"), source.alias("_source"),
        words.alias("_size"))
    sizes = saved(rows.groupBy("_d", "_t", "_source").agg(F.max("_size").alias("_size"),
                                                          F.count(F.lit(1)).alias("_m")),
                  "mix-sizes")
    per = saved(source_targets(sizes, weights, budget, cap), "mix-sources")
    k = F.col("_n")
    right = per.withColumnRenamed("_source", "_s")
    dealt = sizes.join(right, sizes["_source"].eqNullSafe(right["_s"])) \
        .withColumn("_b", F.pmod(F.xxhash64("_d", "_t"), F.ceil(k / bucket_rows)))
    groups = dealt.groupBy("_source", "_b").agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.max("_rate").alias("_rate"),
        F.sort_array(F.collect_list(F.struct("_size", "_d", "_t", "_m")), asc=False).alias("_items"))
    groups = groups.withColumn("_copies", _copies(F.col("_items"), F.col("_rate")))
    flat = groups.select("_source", "source_size", "target",
                         F.explode(F.arrays_zip("_items", "_copies")).alias("_x"))
    size = F.col("_x._items._size")
    return flat.select(
        F.col("_x._items._d").alias("_d"), F.col("_x._items._t").alias("_t"), "_source",
        F.col("_x._items._m").alias("_m"), size.alias("size"), "source_size", "target",
        F.col("_x._copies").alias("copies"),
        (size * F.col("_x._copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with every row present as often as the mix takes it (0, 1 or 2 times)."""
    take = mix_sources(docs, **kw).select(
        F.col("_d").alias("_mix_d"), F.col("_t").alias("_mix_t"), F.col("_source").alias("_mix_s"),
        "copies").withColumnRenamed("copies", "_mix_copies")
    idc, txt, src = kw.get("id_col", "doc_id"), kw.get("text_col", "text"), kw.get("source_col", "source")
    left = docs.withColumn("_mix_ld", F.coalesce(F.col(f"`{idc}`").cast("long"), F.lit(-(1 << 63)))) \
        .withColumn("_mix_lt", F.xxhash64(F.col(f"`{txt}`")))
    on = ((F.col("_mix_ld") == F.col("_mix_d")) & (F.col("_mix_lt") == F.col("_mix_t"))
          & F.col(f"`{src}`").cast("string").eqNullSafe(F.col("_mix_s")))
    both = left.join(take.filter("_mix_copies > 0"), on)
    return both.withColumn("_mix_i", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    got = mix_sources(docs, **kw)
    return got.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int")))) \
        .select(id_of("_d").alias("doc_id"), "size", "source_size", "target", "taken")
