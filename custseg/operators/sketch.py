"""Mergeable quantile sketch: counts on a logarithmic scale, per group and day.

A value's slot is ``ceil(ln |x| / ln g)`` with ``g = (1 + a) / (1 - a)``; a sketch is one
row per (group, sign, slot) with a count.  Sketches of parts are added by summing
counts, so a day's sketch is written once (``put``) and a window is the sum of its
days (``merged``).  A quantile is the middle of the slot in which its order statistic
lies, at most the share ``a`` (``accuracy``) away from that order statistic, whatever
the distribution, order or partitions of the rows.

A group's rows are bounded by the scale, not by the data: about ``ln(max / min) / 2a``
a sign, 1,400 for values from one cent to ten billion at 1 %, 73,000 for all doubles.
The sketch is chosen by the caller (an explicit ``accuracy``), never by size.

Cases: NULL, NaN and infinite values take no part; zero has a slot of its own; a
group without values has no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACCURACY = 0.01
EDGE = 1e-9           # a value on a slot's edge belongs to the lower slot in every engine


def log_step(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy is a share between 0 and 1")
    return math.log1p(2 * accuracy / (1 - accuracy))


def sketch(df: DataFrame, by: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """``by…, side, slot, n``; ``side`` is the sign of the values."""
    x = F.col(value).cast("double")
    slot = F.when(x == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(x)) / F.lit(log_step(accuracy)) - F.lit(EDGE)))
    return df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))).groupBy(
        *by, F.signum(x).cast("int").alias("side"), slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of all rows whose sketches are given (any number per group)."""
    return sketches.groupBy(*by, "side", "slot").agg(F.sum("n").alias("n"))


def put(sketches: DataFrame, path: str, day: str = "day") -> None:
    """Writes a folder per ``day`` and replaces only the days given, so a run can be repeated."""
    sketches.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(day).parquet(path)


def merged(spark: SparkSession, path: str, by: list[str], first: int, last: int, day: str = "day") -> DataFrame:
    """The sketch of the days ``first`` to ``last``; other days are not read."""
    return merge(spark.read.parquet(path).filter(F.col(day).between(first, last)), by)


def quantiles(sketches: DataFrame, by: list[str], probs: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """``by…, n, q0, q1, …``: for each p the order statistic of rank floor(p(n-1)) + 1,
    within the share ``accuracy``.  One sketch per group."""
    step = log_step(accuracy)
    group = Window.partitionBy(*by)
    order = group.orderBy("side", F.col("side") * F.col("slot"))
    middle = F.col("side") * F.lit(2 / (math.exp(step) + 1)) * F.exp(F.col("slot") * F.lit(step))
    placed = sketches.select(*by, F.sum("n").over(order).alias("_upto"), F.col("n").alias("_w"),
                             F.sum("n").over(group).alias("_n"), middle.alias("_x"))
    aggs = []
    for j, p in enumerate(probs):
        rank = F.floor((F.col("_n") - 1) * F.lit(p)) + 1
        here = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_w") < rank)
        aggs.append(F.max(F.when(here, F.col("_x"))).alias(f"q{j}"))
    return placed.groupBy(*by, F.col("_n").alias("n")).agg(*aggs)
