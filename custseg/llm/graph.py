"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``, longs): the label is the
    component's least node.  Each round takes the least label of the neighbours
    (partial sums, so a hub is no hot task) and then the label of the label;
    tables are written between rounds, so nothing is recomputed or held.  Labels only
    fall, so the rounds end; they go on until none changes."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .filter("a <> b").distinct(), "cc-links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
                   .select("node", F.least("node", "_m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_l"))
        least = saved(labels.join(near, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_l", "label")).alias("_new")),
            "cc-least")
        jump = least.select(F.col("node").alias("_new"), F.col("_new").alias("_next"))
        labels = saved(least.join(jump, "_new", "left").select(
            "node", "_old", F.least("_new", F.coalesce("_next", "_new")).alias("label")), "cc-labels")
        changed = labels.filter("label <> _old").limit(1).count()
        labels = labels.drop("_old")
        if not changed:
            return labels
