"""Quartile scores, RFMT code, score and Gold/Silver/Bronze tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.operators.quantiles import TileSpec, with_ntiles

KEY = "Customer_Key"

# fixed values: metric -> quartile column, and rank direction (recent = 4)
QUARTILE_SPECS = {
    "RecencyDays": TileSpec("RecencyDays", "R_Quantile", ascending=False),
    "Frequency": TileSpec("Frequency", "F_Quantile"),
    "Monetary": TileSpec("Monetary", "M_Quantile"),
    "Tenure": TileSpec("Tenure", "T_Quantile"),
    "Streaming": TileSpec("Streaming", "S_Quantile"),
}
# fixed values: tier thresholds (score strictly above) and their order
TIERS_RFMT = ((12, "Gold"), (8, "Silver"), (0, "Bronze"))
TIERS_RFMTS = ((14, "Gold"), (9, "Silver"), (0, "Bronze"))
TIER_ORDER = {"Gold": 1, "Silver": 2, "Bronze": 3}


def add_quartiles(features: DataFrame, metrics: list[str], buckets: int = 4) -> DataFrame:
    """Append ``X_Quantile`` (1..4) for each metric; exact, no single partition."""
    return with_ntiles(features, KEY, [QUARTILE_SPECS[m] for m in metrics], buckets)


def add_score(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """``RFM_Segment = paste0(quartiles)``, ``Score = sum(quartiles)``.
    A NULL quartile gives a NULL code and score."""
    qs = [F.col(QUARTILE_SPECS[m].out) for m in metrics]
    score = qs[0]
    for q in qs[1:]:
        score = score + q
    return scored.withColumn("RFM_Segment", F.concat(*[q.cast("string") for q in qs])) \
                 .withColumn("Score", score.cast("int"))


def add_tier(scored: DataFrame, tiers=TIERS_RFMT) -> DataFrame:
    """``Customer_Segment`` by score thresholds plus its ordinal
    ``Segment_Order`` (Gold=1, Silver=2, Bronze=3)."""
    expr = None
    for threshold, name in tiers:
        cond = F.col("Score") > threshold
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    order = None
    for threshold, name in tiers:
        cond = F.col("Score") > threshold
        v = F.lit(TIER_ORDER[name])
        order = F.when(cond, v) if order is None else order.when(cond, v)
    return scored.withColumn("Customer_Segment", expr) \
                 .withColumn("Segment_Order", order.cast("int"))


def customer_tiers(features: DataFrame, metrics: list[str] | None = None,
                   tiers=TIERS_RFMT) -> DataFrame:
    """Full tiering: quartiles -> code + score -> tier."""
    metrics = metrics or ["RecencyDays", "Frequency", "Monetary", "Tenure"]
    return add_tier(add_score(add_quartiles(features, metrics), metrics), tiers)
