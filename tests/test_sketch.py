"""Quantile sketch: accuracy, merging, days, odd values."""

import math

import numpy as np
import pytest

from custseg.operators import profiles, sketch
from custseg.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]


def values(seed):
    rng = np.random.default_rng(seed)
    return {"wide": rng.lognormal(3, 3, 3000), "signed": rng.normal(0, 50, 3001),
            "tied": rng.choice([0.0, 0.0, 5.0, -2.5], 1000), "one": np.array([42.0])}


def table(spark, data):
    rows = [(g, i, float(x), i % 5) for g, xs in data.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "g string, id long, x double, day int")


@pytest.mark.parametrize("accuracy", [0.1, 0.01, 0.001])
def test_within_the_share(spark, accuracy):
    data = values(1)
    got = sketch.quantiles(sketch.sketch(table(spark, data), ["g"], "x", accuracy), ["g"], PROBS, accuracy).collect()
    assert {r["g"]: r["n"] for r in got} == {g: len(x) for g, x in data.items()}
    for r in got:
        x = np.sort(data[r["g"]])
        for j, p in enumerate(PROBS):
            want = x[math.floor((len(x) - 1) * p)]
            assert abs(r[f"q{j}"] - want) <= accuracy * abs(want) * (1 + 1e-6) + 1e-12


def test_rank_error_against_exact_quantiles(spark):
    data = {"wide": values(2)["wide"]}
    df = table(spark, data)
    exact = exact_quantiles(df, ["g"], "x", "id", [0.25, 0.5, 0.75]).collect()[0]
    near = sketch.quantiles(sketch.sketch(df, ["g"], "x"), ["g"], [0.25, 0.5, 0.75]).collect()[0]
    x = np.sort(data["wide"])
    for j in range(3):
        ranks = np.searchsorted(x, [exact[f"q{j}"], near[f"q{j}"]])
        assert abs(int(ranks[0]) - int(ranks[1])) <= 0.01 * len(x)


def test_days_add_up(spark, tmp_path):
    df, path = table(spark, values(3)), str(tmp_path / "s")
    whole = sorted(map(tuple, sketch.sketch(df, ["g"], "x").collect()))
    sketch.put(sketch.sketch(df.filter("day < 3"), ["g", "day"], "x"), path)
    sketch.put(sketch.sketch(df.filter("day >= 3"), ["g", "day"], "x"), path)
    sketch.put(sketch.sketch(df.filter("day = 2"), ["g", "day"], "x"), path)          # a repeated run
    assert sorted(map(tuple, sketch.merged(spark, path, ["g"], 0, 4).collect())) == whole
    part = sketch.merged(spark, path, ["g"], 1, 3)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, sketch.sketch(df.filter("day between 1 and 3"), ["g"], "x").collect()))
    assert "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().executedPlan().toString()
    spread = df.repartition(13)
    assert sorted(map(tuple, sketch.sketch(spread, ["g"], "x").collect())) == whole


def test_odd_values(spark):
    rows = [("a", None), ("a", math.nan), ("a", math.inf), ("a", -math.inf), ("b", None), (None, 0.0), (None, -1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = sketch.quantiles(sketch.sketch(df, ["g"], "x"), ["g"], [0.0, 0.5, 1.0]).collect()
    assert len(got) == 1 and got[0]["g"] is None and got[0]["n"] == 3
    assert abs(got[0]["q0"] + 1) <= 0.01 and got[0]["q1"] == 0 and abs(got[0]["q2"] - 1) <= 0.01
    assert sketch.quantiles(sketch.sketch(df.limit(0), ["g"], "x"), ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        sketch.log_step(0)


def test_boxes_by_sketch(spark):
    long = table(spark, {"g": values(4)["wide"]}).selectExpr("g", "'Monetary' AS metric", "x AS value", "id AS Customer_Key")
    exact = profiles.box_stats(long, "g").collect()[0]
    near = profiles.box_stats(long, "g", accuracy=0.001).collect()[0]
    assert near["n"] == exact["n"]
    for c in ("q1", "median", "q3"):
        assert abs(near[c] - exact[c]) <= 0.01 * abs(exact[c])
