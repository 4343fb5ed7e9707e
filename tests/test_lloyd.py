"""Batched k-means against a direct numpy version; the same on any layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from custseg.operators import clusters, cohorts, lloyd

COLS = ["RecencyDays", "Frequency", "Monetary", "Tenure", "Streaming"]
SCHEMA = "Customer_Key long, Segment string, " + ", ".join(f"{c} double" for c in COLS)


def blobs(seed=4, n=180, gaps=False):
    rng = np.random.default_rng(seed)
    means = np.array([(0, 0, 0, 0, 0), (6, 6, 0, 0, 6), (0, 6, 6, 6, 0)])
    x = means[np.arange(n) % 3] + rng.normal(0, 0.8, (n, 5))
    rows = []
    for i, r in enumerate(x):
        v = [float(t) for t in r]
        if gaps and i % 7 == 0:
            v[i % 5] = None if i % 2 else float("nan")
        rows.append((i, "ab"[i % 2] if i % 9 else None, *v))
    return rows


def direct(rows, ks, steps, test=None):
    """Farthest-point start and Lloyd steps, one model at a time."""
    def whole(part):
        return np.array([[np.nan if v is None or v != v else np.floor(abs(v) * 1e6 + 0.5) * np.sign(v) for v in r[2:]]
                         for r in part])
    x = whole(rows)
    fill = np.round(np.nansum(x, 0) / (~np.isnan(x)).sum(0))
    x = np.where(np.isnan(x), fill, x)
    dist = lambda a, c: sum((a[:, j] - c[j]) ** 2 for j in range(a.shape[1]))
    least = lambda key: x[min(np.flatnonzero(key == key.min()), key=lambda i: tuple(x[i]))]
    seq = [least(dist(x, fill))]
    while len(seq) < max(ks):
        far = np.min([dist(x, c) for c in seq], 0)
        if far.max() == 0:
            break
        seq.append(least(-far))
    out = {}
    scored = x if test is None else np.where(np.isnan(whole(test)), fill, whole(test))
    for k in ks:
        c = np.array(seq[:k])
        for _ in range(steps):
            label = np.argmin([dist(x, v) for v in c], 0)
            c = np.array([x[label == j].sum(0) / (label == j).sum() if (label == j).any() else c[j]
                          for j in range(len(c))])
        out[k] = (c, np.rint(np.min([dist(scored, v) for v in c], 0) * 1e-3).sum() / 1e9)
    return out


def models(df, **kw):
    return {(r["_g"], r["f"], r["k"]): (r["n"], r["sse"], r["centres"], r["fill"])
            for r in lloyd.fit(df, COLS, [1, 2, 3, 5], 6, **kw).collect()}


@pytest.mark.parametrize("gaps", [False, True])
def test_equals_the_direct_version(spark, gaps):
    rows = blobs(gaps=gaps)
    got = models(spark.createDataFrame(rows, SCHEMA))
    for k, (c, sse) in direct(rows, [1, 2, 3, 5], 6).items():
        n, s, centres, _ = got["", -1, k]
        assert n == len(rows) and np.array_equal(np.array(centres), c) and np.isclose(s, sse, rtol=1e-12)


def test_same_on_any_layout(spark, monkeypatch):
    """1, 4 and 64 partitions, adaptive execution on and off, small blocks, states as a table."""
    rows = blobs(seed=9, gaps=True)
    df = spark.createDataFrame(rows, SCHEMA)
    want = models(df.coalesce(1))
    assert models(df.repartition(4)) == want and models(df.repartition(64, F.rand(3))) == want
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert models(df.repartition(5)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert models(df, state_bytes=0) == want


def test_groups_and_folds_equal_separate_fits(spark):
    rows = blobs(seed=11, n=120)
    df = spark.createDataFrame(rows, SCHEMA)
    grouped = models(df, group_cols=["Segment"])
    for s in ("a", "b", None):
        g = df.select(lloyd.group_key(["Segment"]).alias("g"), "Segment").filter(
            F.col("Segment").eqNullSafe(F.lit(s))).first()["g"]
        alone = direct([r for r in rows if r[1] == s], [1, 2, 3, 5], 6)
        for k, (c, sse) in alone.items():
            assert np.array_equal(np.array(grouped[g, -1, k][2]), c) and np.isclose(grouped[g, -1, k][1], sse)
    assert models(df, group_cols=["Segment"], state_bytes=0) == grouped
    folded = models(df, fold=F.pmod(F.col("Customer_Key"), F.lit(3)), folds=3)
    for f in range(3):
        alone = direct([r for r in rows if r[0] % 3 != f], [1, 2, 3, 5], 6, [r for r in rows if r[0] % 3 == f])
        for k, (c, sse) in alone.items():
            assert np.array_equal(np.array(folded["", f, k][2]), c) and np.isclose(folded["", f, k][1], sse)


def test_repeated_rows_and_few_distinct(spark):
    rows = [(i, "a", *([float(i % 3)] * 5)) for i in range(50)]
    got = models(spark.createDataFrame(rows, SCHEMA))
    assert len(got["", -1, 5][2]) == 3 and got["", -1, 5][1] == 0 and got["", -1, 2][1] > 0
    one = models(spark.createDataFrame([(1, None, 1.0, 2.0, 3.0, None, 4.0)] * 4, SCHEMA))
    assert one["", -1, 5][2] == [[1e6, 2e6, 3e6, 0.0, 4e6]]
    assert models(spark.createDataFrame([], SCHEMA)) == {}


def test_segments_keep_null_and_jobs_do_not_grow(spark):
    """Each segment has its own k; the passes advance all of them, so 40 segments
    take no more jobs than the passes allow."""
    def jobs(segments):
        rows = [(i, None if s == 0 else f"s{s}", *r[2:]) for s in range(segments) for i, r in enumerate(blobs(s, 60))]
        df = spark.createDataFrame([(s * 1000 + r[0], *r[1:]) for s, r in zip(np.repeat(range(segments), 60).tolist(), rows)],
                                   SCHEMA)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        lab = cohorts.segment_clusters(df, COLS).groupBy("Segment").agg(
            F.count(F.lit(1)).alias("n"), F.max("Cluster").alias("k")).collect()
        assert {r["Segment"] for r in lab} == {None, *[f"s{s}" for s in range(1, segments)]}
        assert all(r["n"] == 60 for r in lab) and all(r["k"] >= 2 for r in lab)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert jobs(3) < 110 and jobs(40) < 110      # 20 passes at most, a few jobs each


def test_labels_and_order_of_ids(spark):
    df = spark.createDataFrame(blobs(), SCHEMA)
    model, curve = clusters.auto_k(df, COLS)
    assert model.k == 3 and [k for k, _ in curve] == [1, 2, 3, 4]
    scores = [sum(c[1:]) - c[0] for c in model.centers()]
    assert scores == sorted(scores, reverse=True)
    pred = model.predict(df)
    near = pred.select("Cluster", clusters.nearest_cluster(COLS, model.centers()).alias("n"))
    assert near.filter("Cluster != n").count() == 0
    fixed = clusters.fixed_k(df, COLS, 4, standardize=True)
    assert fixed.k == 4 and fixed.predict(df).filter("Cluster is null").count() == 0


def test_score_refits_the_transform_only(spark, tmp_path):
    """Two clusters at least; the re-fitted transform of shifted customers gives
    them the clusters that the stored one gives the original customers."""
    rows = blobs(seed=2, n=150)
    df = spark.createDataFrame(rows, SCHEMA).drop("Segment")
    path = str(tmp_path / "model")
    cohorts.train(df, COLS, path)
    own = {r["Customer_Key"]: r["Cluster"] for r in cohorts.score(path, df, COLS).collect()}
    assert len(set(own.values())) >= 2
    same = {r["Customer_Key"]: r["Cluster"] for r in cohorts.score(path, df, COLS, refit=True).collect()}
    assert same == own
    moved = df.select("Customer_Key", *[(F.col(c) + 1000).alias(c) for c in COLS])
    plain = {r["Cluster"] for r in cohorts.score(path, moved, COLS).collect()}
    refit = {r["Cluster"] for r in cohorts.score(path, moved, COLS, refit=True).collect()}
    assert len(plain) == 1 and refit == set(own.values())
