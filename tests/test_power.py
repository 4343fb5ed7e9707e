"""Yeo-Johnson transform, λ search and standardisation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from custseg.functions.power import yeo_johnson
from custseg.operators import power


def yj_np(x, lam):
    x = np.asarray(x, float)
    out = np.empty_like(x)
    pos = x >= 0
    if abs(lam) < 1e-3:
        out[pos] = np.log1p(x[pos])
    else:
        out[pos] = ((x[pos] + 1) ** lam - 1) / lam
    if abs(lam - 2) < 1e-3:
        out[~pos] = -np.log1p(-x[~pos])
    else:
        out[~pos] = -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def loglik_np(x, lam):
    y = yj_np(x, lam)
    return -0.5 * len(x) * math.log(y.var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))


@pytest.mark.parametrize("lam", [-2.5, 0.0, 0.0004, 0.5, 1.0, 2.0, 3.7])
def test_transform_matches_formula(spark, lam):
    xs = [-7.5, -1.0, -0.2, 0.0, 0.3, 2.0, 50.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(yeo_johnson("x", lam)).collect()]
    assert np.allclose(got, yj_np(xs, lam), rtol=1e-12, atol=1e-12)


def test_lambda_is_grid_optimum(spark):
    rnd = np.random.default_rng(3)
    x = np.round(rnd.lognormal(3, 1, 400), 2) - 5       # skewed, some negatives
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "Customer_Key long, m double")
    row = power.yeo_johnson_lambdas(df, ["m"]).collect()[0]
    lam = row["lambda"]
    assert lam is not None and -5 < lam < 5
    # no point of a fine brute-force grid beats it by more than the grid step allows
    brute = max(np.arange(-5, 5.0001, 0.001), key=lambda l: loglik_np(x, l))
    assert abs(brute - lam) <= 0.002
    assert abs(row["loglik"] - loglik_np(x, lam)) < 1e-6 * abs(row["loglik"])


def test_few_distinct_values_untransformed(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "Customer_Key long, m double")
    assert power.yeo_johnson_lambdas(df, ["m"]).collect()[0]["lambda"] is None


def test_standardise_mean_zero_sd_one_and_constant_column(spark):
    rows = [(i, float(i * i % 17), 3.0) for i in range(60)]
    df = spark.createDataFrame(rows, "Customer_Key long, a double, c double")
    params = power.fit_power_standardise(df, ["a", "c"])
    out = power.apply_power_standardise(df, params, ["a", "c"])
    st = out.agg(F.avg("a"), F.stddev_samp("a"), F.min("c"), F.max("c")).collect()[0]
    assert abs(st[0]) < 1e-9 and abs(st[1] - 1) < 1e-9
    assert st[2] == 0.0 and st[3] == 0.0               # constant column -> 0.0
    assert out.count() == 60


def test_grouped_fit_equals_separate_fits(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, "A" if i % 2 else "B", float(rnd.gamma(2, 10))) for i in range(300)]
    df = spark.createDataFrame(rows, "Customer_Key long, Segment string, m double")
    grouped = {r["Segment"]: r["lambda"] for r in
               power.yeo_johnson_lambdas(df, ["m"], ["Segment"]).collect()}
    for seg in "AB":
        alone = power.yeo_johnson_lambdas(df.filter(F.col("Segment") == seg), ["m"]).collect()[0]
        assert grouped[seg] == alone["lambda"]


def test_ml_estimator_roundtrip(spark, tmp_path):
    from pyspark.ml import PipelineModel, Pipeline
    rows = [(i, float(i % 23) * 3.1, float((i * 7) % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, "Customer_Key long, a double, b double")
    model = Pipeline(stages=[power.YeoJohnsonScaler(inputCols=["a", "b"])]).fit(df)
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    x = model.transform(df).orderBy("Customer_Key").collect()
    y = again.transform(df).orderBy("Customer_Key").collect()
    assert x == y
    fn = power.fit_power_standardise(df, ["a", "b"])
    ref = power.apply_power_standardise(df, fn, ["a", "b"]).orderBy("Customer_Key").collect()
    assert all(abs(p["a"] - q["a"]) < 1e-12 for p, q in zip(x, ref))


def test_null_group_and_group_without_values_keep_their_rows(spark):
    rows = [(i, "a" if i % 2 else None, float(i * i)) for i in range(40)] + [(99, "empty", None)]
    df = spark.createDataFrame(rows, "Customer_Key long, Segment string, m double")
    params = power.fit_power_standardise(df, ["m"], ["Segment"])
    got = power.apply_power_standardise(df, params, ["m"], ["Segment"]).collect()
    assert sorted(r["Customer_Key"] for r in got) == sorted(r[0] for r in rows)
    for seg in ("a", None):
        m = np.array([r["m"] for r in got if r["Segment"] == seg])
        assert abs(m.mean()) < 1e-9 and abs(m.std(ddof=1) - 1) < 1e-9
    assert [r["m"] for r in got if r["Segment"] == "empty"] == [None]
