"""Distributed exact ntile == single-partition NTILE on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from custseg.operators.quantiles import TileSpec, exact_ntile, laid_out, ntile_bucket
from tests.reference_impl import window_ntile

SPECS = [TileSpec("v", "q"), TileSpec("v", "qd", ascending=False)]


def _frame(spark, values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)],
                                 "Customer_Key long, v double")


def _check(spark, values, partitions=None, buckets=4):
    df = _frame(spark, values)
    got = {r["Customer_Key"]: (r["q"], r["qd"]) for r in
           exact_ntile(df, "Customer_Key", SPECS, buckets, partitions).collect()}
    ref = {r["Customer_Key"]: (r["q"], r["qd"]) for r in
           window_ntile(df, "Customer_Key", SPECS, buckets).collect()}
    ref = {k: v for k, v in ref.items() if v != (None, None)}
    assert got == ref


@pytest.mark.parametrize("values", [
    [5.0],                                     # one customer
    [3.0, 1.0, 2.0],                           # fewer rows than buckets
    [float(i % 3) for i in range(10)],         # ties at the quartile edges, n mod 4 = 2
    [7.0] * 11,                                # constant metric
    [1.0, None, 3.0, None, 2.0, 5.0, 4.0],     # NULLs are not ranked
    [0.0] * 40 + [float(i) for i in range(80)],  # a third of the rows share one value
])
def test_ntile_matches_window(spark, values):
    _check(spark, values)


def test_ntile_many_partitions_random(spark):
    rnd = random.Random(7)
    values = [float(rnd.randint(0, 9)) if rnd.random() < .8 else rnd.random() for _ in range(997)]
    _check(spark, values, partitions=13)
    _check(spark, values, partitions=1)


def test_bucket_sizes_differ_by_at_most_one(spark):
    n = 10
    df = spark.range(1, n + 1).select(F.col("id").alias("g"))
    sizes = df.select(ntile_bucket(F.col("g"), F.lit(n), 4).alias("b")).groupBy("b").count() \
        .orderBy("b").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]    # larger buckets first (SQL NTILE)


def test_no_single_partition_exchange(spark):
    df = _frame(spark, [float(i) for i in range(100)])
    plan = exact_ntile(df, "Customer_Key", SPECS)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    # the ranks are read from a written layout; the range exchange is in the plan that writes it
    layout = laid_out(df, [], SPECS[0].value, "Customer_Key")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in layout
    assert "rangepartitioning" in layout


def test_exact_sample_size_and_determinism(spark):
    from custseg.operators.quantiles import exact_sample
    df = spark.range(0, 997).withColumnRenamed("id", "k")
    a = exact_sample(df, 0.2, 42, "k")
    b = exact_sample(df.repartition(5), 0.2, 42, "k")
    ka = sorted(r["k"] for r in a.collect())
    assert len(ka) == round(997 * 0.2)
    assert ka == sorted(r["k"] for r in b.collect())


def test_buckets_are_a_projection(spark, tmp_path):
    """The order of keys is needed for ties at a border only; all other rows are compared
    with the borders, without an exchange."""
    from custseg.operators.quantiles import borders, value_histogram, with_ntiles
    spark.range(10_000).selectExpr("id as Customer_Key", "cast(id % 7 as double) as v").write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    plan = with_ntiles(df, "Customer_Key", SPECS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    assert value_histogram(df, SPECS).count() == 14
    ends = borders(df, "Customer_Key", SPECS)
    assert [len(e) for e in ends] == [3, 3]
    assert all(k is not None and k % 7 == abs(v) for e in ends for v, k in e)


def test_borders_with_string_keys_and_extremes(spark):
    rows = [(f"c{i:03d}", v) for i, v in enumerate([float("inf"), float("-inf"), -0.0, 0.0, 0.0, 0.0, 1e300, -1e300, 5.0])]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["q"] for r in exact_ntile(df, "k", [TileSpec("v", "q")]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {k: 1 if i < 3 else 2 + (i - 3) // 2 for i, (k, _) in enumerate(order)}
