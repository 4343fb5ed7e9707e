"""Profiles, box statistics, nearest-centroid arithmetic and k-means."""

import numpy as np
from pyspark.sql import functions as F

from custseg.operators import clusters, profiles, scoring


def test_tiers_and_scores(spark):
    df = spark.createDataFrame([(i, i % 7, i % 5, float(i), i * 2) for i in range(1, 41)],
                               "Customer_Key long, RecencyDays int, Frequency long, Monetary double, Tenure int")
    t = scoring.customer_tiers(df)
    rows = t.collect()
    assert all(4 <= r["Score"] <= 16 for r in rows)
    for r in rows:
        exp = "Gold" if r["Score"] > 12 else "Silver" if r["Score"] > 8 else "Bronze"
        assert r["Customer_Segment"] == exp
        assert r["RFM_Segment"] == f"{r['R_Quantile']}{r['F_Quantile']}{r['M_Quantile']}{r['T_Quantile']}"
    counts = profiles.tier_counts(t).agg(F.sum("n")).collect()[0][0]
    assert counts == 40


def test_box_stats_match_numpy(spark):
    rnd = np.random.default_rng(1)
    vals = rnd.normal(0, 2, 301)
    vals[:3] = [9.0, -9.0, 4.9]
    df = spark.createDataFrame([(i, 1, "m", float(v)) for i, v in enumerate(vals)],
                               "Customer_Key long, Cluster int, metric string, value double")
    r = profiles.box_stats(df, "Cluster", value_range=(-5.0, 5.0)).collect()[0]
    kept = vals[(vals >= -5) & (vals <= 5)]
    q1, med, q3 = np.percentile(kept, [25, 50, 75])          # linear = R type 7
    assert (round(q1, 6), round(med, 6), round(q3, 6)) == (r["q1"], r["median"], r["q3"])
    iqr = q3 - q1
    assert r["upper"] == round(kept[kept <= q3 + 1.5 * iqr].max(), 6)
    assert r["lower"] == round(kept[kept >= q1 - 1.5 * iqr].min(), 6)
    assert r["n"] == len(kept)


def test_histogram_density_integrates_to_one(spark):
    df = spark.createDataFrame([("a", "g", float(v)) for v in range(100)] +
                               [("a", "h", float(v) / 2) for v in range(30)],
                               "name string, grp string, value double")
    h = profiles.histogram_density(df, "grp").collect()
    for g in "gh":
        area = sum(r["density"] * (r["bin_hi"] - r["bin_lo"]) for r in h if r["grp"] == g)
        assert abs(area - 1) < 1e-4


def test_nearest_cluster_brute_force(spark):
    rnd = np.random.default_rng(2)
    pts = rnd.normal(0, 1, (200, 3))
    centres = [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [-1.0, 0.5, 2.0]]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, a double, b double, c double")
    got = {r["k"]: r["cl"] for r in df.select("k", clusters.nearest_cluster(["a", "b", "c"], centres).alias("cl")).collect()}
    for i, p in enumerate(pts):
        assert got[i] == 1 + int(np.argmin(((np.array(centres) - p) ** 2).sum(1)))


def test_kmeans_invariants(spark):
    # five features, like RFMTS, so the stop rule's cutoff is
    # min(0.02 + 10/n + 2.5/25, 0.8) ~ 0.18
    rnd = np.random.default_rng(4)
    cols = ["RecencyDays", "Frequency", "Monetary", "Tenure", "Streaming"]
    means = ((0, 0, 0, 0, 0), (6, 6, 0, 0, 6), (0, 6, 6, 6, 0))
    blobs = np.vstack([rnd.normal(m, .3, (60, 5)) for m in means])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(blobs)],
                               "Customer_Key long, " + ", ".join(f"{c} double" for c in cols))
    data = clusters.prepare(df)
    model, curve = clusters.auto_k(data, cols)
    assert model is not None and model.k == 3
    sses = [v for _k, v in curve]
    assert all(b <= a * 1.0001 for a, b in zip(sses, sses[1:]))
    pred = model.predict(data)
    assert pred.count() == 180 and pred.filter(F.col("Cluster").isNull()).count() == 0
    centres = model.centers()
    scores = [sum(c[1:]) - c[0] for c in centres]
    assert scores == sorted(scores, reverse=True)          # id 1 = best F+M+T+S-R
    # every row sits at its nearest centre
    near = pred.select("Cluster", clusters.nearest_cluster(cols, centres).alias("n"))
    assert near.filter(F.col("Cluster") != F.col("n")).count() == 0


def test_scree_curve_shape(spark):
    rnd = np.random.default_rng(6)
    blobs = np.vstack([rnd.normal(m, .2, (40, 2)) for m in ((0, 0), (3, 3))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(blobs)],
                               "Customer_Key long, a double, b double")
    curve = clusters.scree_curve(clusters.prepare(df), ["a", "b"], k_max=4, folds=3)
    assert [k for k, _ in curve] == [1, 2, 3, 4]
    assert curve[1][1] < curve[0][1] * 0.3


def test_scree_curve_counts_customers_with_missing_metrics(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, float(x), None if i % 3 == 0 else float(y) if i % 7 else float("nan"))
            for i, (x, y) in enumerate(rnd.normal(0, 2, (90, 2)))]
    df = spark.createDataFrame(rows, "Customer_Key long, a double, b double")
    curve = dict(clusters.scree_curve(clusters.prepare(df), ["a", "b"], k_max=2, folds=3))
    fold = {r["Customer_Key"]: r["f"] for r in df.select(
        "Customer_Key", F.pmod(F.xxhash64("Customer_Key"), F.lit(3)).alias("f")).collect()}
    want = 0.0
    for f in range(3):
        x = np.array([[a, np.nan if b is None else b] for i, a, b in rows if fold[i] != f])
        t = np.array([[a, np.nan if b is None else b] for i, a, b in rows if fold[i] == f])
        want += float(np.nansum((t - np.nanmean(x, 0)) ** 2))    # a missing metric adds 0
    assert np.isclose(curve[1], want) and 0 < curve[2] < curve[1]


def test_exact_quantiles_with_heavy_ties(spark):
    from custseg.operators.quantiles import exact_quantiles
    vals = [0.0] * 100 + [float(v) for v in range(1, 201)] + [None] * 5
    df = spark.createDataFrame([(i, "g" if i % 2 else "h", v) for i, v in enumerate(vals)],
                               "k long, grp string, v double")
    got = {r["grp"]: r for r in exact_quantiles(df, ["grp"], "v", "k", [0.1, 0.25, 0.5, 0.9]).collect()}
    for g, sel in (("g", 1), ("h", 0)):
        xs = np.array([v for i, v in enumerate(vals) if v is not None and i % 2 == sel])
        ref = np.percentile(xs, [10, 25, 50, 90])
        assert got[g]["n"] == len(xs)
        assert np.allclose([got[g][f"q{j}"] for j in range(4)], ref, rtol=0, atol=1e-12)


def test_profile_value_range_and_relative_importance(spark):
    df = spark.createDataFrame([(1, "A", 1, 3.0, 1.0), (2, "A", 1, 1.0, 1.0), (3, "B", 2, -4.0, 1.0)],
                               "Customer_Key long, Customer_Segment string, Segment_Order int, RecencyDays double, Frequency double")
    p = profiles.profile_long(df, "Customer_Segment", ["RecencyDays", "Frequency"], value_range=(-2, 2))
    got = {(r["Customer_Segment"], r["metric"]): r["value"] for r in p.collect()}
    assert got == {("A", "RecencyDays"): 2.0, ("A", "Frequency"): 1.0, ("B", "Frequency"): 1.0}
    t = spark.createDataFrame([("Gold", 1, 2, 4, 10.0, 30), ("Gold", 1, 4, 4, None, 30), ("Bronze", 3, 6, 1, 2.0, 30)],
                              "Customer_Segment string, Segment_Order int, RecencyDays int, Frequency long, Monetary double, Tenure int")
    ri = {(r["Customer_Segment"], r["metric"]): r["value"] for r in profiles.relative_importance(t).collect()}
    assert ri[("Gold", "Recency")] == round(3 / 4 - 1, 6)
    assert ri[("Gold", "Monetary")] == round(10 / 6 - 1, 6)          # NULL skipped (na.rm)
    assert ri[("Bronze", "Tenure")] == 0.0


def test_segment_profiles_keep_extreme_clusters(spark, monkeypatch):
    from custseg.plans import queries
    df = spark.createDataFrame([(1, "s", 1, 9.0, 1.0, -3.0, 0.0, 2.5), (2, "s", 2, 0.0, 0.0, 0.0, 0.0, 0.0)],
                               "Customer_Key long, Segment string, Cluster int, "
                               + ", ".join(f"{c} double" for c in queries.RFMTS))
    monkeypatch.setattr(queries, "segment_clusters", lambda spark, sf: df)
    assert queries.segment_profiles(spark, None).count() == 10
    assert queries.segment_profiles(spark, None, (-2.0, 2.0)).count() == 7


def test_export_scores_partitions_by_day(spark, tmp_path):
    import datetime as dt
    from custseg.sources.io import export_scores
    df = spark.createDataFrame([(1, 2), (2, 1)], "Customer_Key long, Cluster int")
    path = str(tmp_path / "scores")
    export_scores(df, path, dt.date(2020, 1, 1))
    export_scores(df.limit(1), path, dt.date(2020, 1, 2))
    export_scores(df, path, dt.date(2020, 1, 2))       # a re-run replaces only its own day
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert {str(r["as_of"]) for r in back.select("as_of").distinct().collect()} == {"2020-01-01", "2020-01-02"}


def test_empty_tier_keeps_real_labels(spark):
    t = spark.createDataFrame([("Gold", 1, 2, 4, 10.0, 30), ("Bronze", 3, 6, 1, 2.0, 10)],
                              "Customer_Segment string, Segment_Order int, RecencyDays int, Frequency long, Monetary double, Tenure int")
    labels = {r["Customer_Segment"] for r in profiles.relative_importance(t).collect()}
    assert labels == {"Gold", "Bronze"}                 # no Silver row invented or shifted
    summ = {r["Customer_Segment"]: r["R_mean"] for r in profiles.tier_summary(t).collect()}
    assert summ == {"Gold": 2.0, "Bronze": 6.0}


def test_zero_means_and_constant_columns_do_not_raise(spark):
    t = spark.createDataFrame([("Gold", 1, 0, 4, 10.0, 30), ("Bronze", 3, 0, 1, 2.0, 30)],
                              "Customer_Segment string, Segment_Order int, RecencyDays int, Frequency long, Monetary double, Tenure int")
    ri = {(r["Customer_Segment"], r["metric"]): r["value"] for r in profiles.relative_importance(t).collect()}
    assert ri[("Gold", "Recency")] is None and ri[("Gold", "Tenure")] == 0.0
    t2 = t.withColumn("Customer_Key", F.monotonically_increasing_id())
    out = profiles.legacy_normalise(t2, ["RecencyDays", "Frequency", "Monetary", "Tenure"],
                                    ["Customer_Key"]).collect()
    assert all(r["Tenure"] is None for r in out) and len(out) == 2


def test_n_init_keeps_lowest_sse(spark):
    rnd = np.random.default_rng(8)
    pts = rnd.normal(0, 1, (150, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "Customer_Key long, a double, b double, c double")
    data = clusters.prepare(df)
    one = [clusters.fit_kmeans(data, ["a", "b", "c"], 4, seed=s).cost for s in (42, 43, 44)]
    best = clusters.fit_kmeans(data, ["a", "b", "c"], 4, seed=42, n_init=3).cost
    assert best == min(one)
