"""Properties of the flagship outputs on the driver's sf0.01 tables."""

from pyspark.sql import functions as F

from custseg.plans import queries as Q
from tests.conftest import SF01


def test_tier_properties(spark):
    t = Q.customer_tiers(spark, SF01).persist()
    n = t.count()
    assert t.filter(F.col("RecencyDays") > F.col("Tenure")).count() == 0
    for q in ("R_Quantile", "F_Quantile", "M_Quantile", "T_Quantile"):
        sizes = [r["c"] for r in t.groupBy(q).agg(F.count(F.lit(1)).alias("c")).collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    assert t.filter((F.col("Score") < 4) | (F.col("Score") > 16)).count() == 0
    counts = Q.tier_counts(spark, SF01).agg(F.sum("n")).collect()[0][0]
    assert counts == n
    t.unpersist()


def test_normalised_properties(spark):
    z = Q.normalised_features(spark, SF01)
    for c in ("RecencyDays", "Monetary", "Tenure", "Streaming"):
        m, s = z.agg(F.avg(c), F.stddev_samp(c)).collect()[0]
        assert abs(m) < 1e-5 and abs(s - 1) < 1e-5


def test_saved_pipeline_scores_like_the_fit(spark):
    a = {r["Customer_Key"]: r["Cluster"] for r in Q.kmeans_auto_k(spark, SF01).select("Customer_Key", "Cluster").collect()}
    b = {r["Customer_Key"]: r["Cluster"] for r in Q.score_customers(spark, SF01).select("Customer_Key", "Cluster").collect()}
    assert a == b and len(a) > 0
