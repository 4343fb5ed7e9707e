"""The distributed rank over several range partitions, against a one-task window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from custseg.operators import clusters
from custseg.operators.quantiles import TileSpec, exact_ntile, exact_quantiles, exact_sample

SETTINGS = [
    {},
    {"spark.sql.adaptive.coalescePartitions.enabled": "false"},
    {"spark.sql.adaptive.enabled": "false"},
]


@pytest.fixture(params=SETTINGS, ids=["adaptive", "no coalescing", "not adaptive"])
def session(spark, request):
    old = {k: spark.conf.get(k) for k in request.param}
    for k, v in request.param.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _frame(spark, n=300_000):
    # f: three values hold nearly all rows; m: wide with NULLs
    h = F.xxhash64("id", F.lit(3))
    return spark.range(n).select(
        F.col("id").alias("k"), F.least(F.pmod(h, F.lit(4)), F.lit(2)).cast("double").alias("f"),
        F.when(F.pmod(h, F.lit(17)) != 0, F.pmod(h, F.lit(90_000)) / 7).alias("m"))


def test_ntile_equals_window(session):
    df = _frame(session)
    got = exact_ntile(df, "k", [TileSpec("f", "tf"), TileSpec("m", "tm", ascending=False)])
    want = df.withColumn("wf", F.ntile(4).over(Window.orderBy("f", "k")))
    wm = df.filter("m is not null").select("k", F.ntile(4).over(Window.orderBy(-F.col("m"), "k")).alias("wm"))
    wrong = got.join(want, "k", "full").join(wm, "k", "left").filter(
        ~F.col("tf").eqNullSafe(F.col("wf")) | ~F.col("tm").eqNullSafe(F.col("wm"))).count()
    assert wrong == 0
    assert got.count() == df.count()


def test_layout_has_several_partitions(session):
    laid = _frame(session).repartitionByRange("f", "k")
    if session.conf.get("spark.sql.adaptive.enabled") == "false" or \
            session.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false":
        assert laid.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_sample_is_exact(session):
    df = _frame(session)
    got = exact_sample(df, 0.2, 42, "k")
    assert got.count() == 60_000
    assert got.select("k").distinct().count() == 60_000


def test_quantiles_equal_percentile(session):
    df = _frame(session).withColumn("g", F.pmod(F.col("k"), F.lit(3)))
    got = {r["g"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, ["g"], "m", "k", [0.25, 0.5]).collect()}
    want = df.groupBy("g").agg(F.percentile("m", F.lit(0.25)).alias("a"), F.percentile("m", F.lit(0.5)).alias("b"))
    for r in want.collect():
        assert got[r["g"]] == pytest.approx((r["a"], r["b"]))


def test_clustering_keeps_customers_without_a_metric(spark):
    rows = [(i, float(i % 2) * 9 + i / 100, None if i % 5 == 0 else float(i % 2) * 7) for i in range(40)]
    df = spark.createDataFrame(rows, "Customer_Key long, Monetary double, Frequency double")
    cols = ["Monetary", "Frequency"]
    for k in (2, 3):
        for standardize in (False, True):
            model = clusters.fit_kmeans(df, cols, k, standardize=standardize)
            assert model.predict(df).count() == 40
            assert len(model.centers()) == k
    model, _ = clusters.auto_k(df, cols)
    assert model.predict(df).count() == 40


def test_one_cluster_is_a_model(spark, tmp_path):
    from custseg.operators import cohorts
    rows = [(i, float(i % 7), float((i * 5) % 11)) for i in range(30)]
    df = spark.createDataFrame(rows, "Customer_Key long, Monetary double, Frequency double")
    cols = ["Monetary", "Frequency"]
    model = clusters.one_cluster(df, cols, clusters.total_ss(df, cols))
    assert model.k == 1 and cohorts.centroid_table(spark, model, cols).count() == 2
    assert {r["Cluster"] for r in model.predict(df).collect()} == {1}
    cohorts.train(df, cols, str(tmp_path / "m"))
    first = sorted(map(tuple, cohorts.score(str(tmp_path / "m"), df, cols).select("Customer_Key", "Cluster").collect()))
    again = sorted(map(tuple, cohorts.score(str(tmp_path / "m"), df, cols, refit=True)
                       .select("Customer_Key", "Cluster").collect()))
    assert first == again and len(first) == 30
