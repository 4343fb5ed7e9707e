"""Registered queries: ``(spark, sf_dir) -> DataFrame``.

Each one reads the driver's tables through ``fixture_sources`` and runs the
library operators on the whole data (no sampling, no key subsets).  Column
names equal those of the oracle SQL in ``custseg.plans.oracles``.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.operators import clusters, cohorts, daily, membership, power, profiles, scoring, sketch
from custseg.operators import features as feat
from custseg.session import shared_path, written
from custseg.sources import bucketed, extracts, relations

Query = Callable[[SparkSession, str], DataFrame]
KEY = "Customer_Key"
RFMT = feat.RFMT
RFMTS = feat.RFMTS


# ------------------------------------------------------------------ builders
def _src(spark, sf):
    return relations.fixture_sources(spark, sf)


def _lines(spark, sf, years):
    return feat.order_lines(extracts.orders_extract(
        _src(spark, sf), years, relations.ORDERS_AS_OF))


def features_3y(spark, sf):
    return feat.premium_features(_src(spark, sf), 3, relations.ORDERS_AS_OF)


def tiers_3y(spark, sf):
    return scoring.customer_tiers(features_3y(spark, sf))


def rfmts_btc(spark, sf, reference="cohort"):
    src = _src(spark, sf)
    return feat.premium_features(src, 1, relations.ORDERS_AS_OF, "BTC", reference,
                                 extracts.streaming_counts(src, 1, relations.READER_AS_OF), extracts.segment_lookup(src))


def rfmts_all_segments(spark, sf):
    src = _src(spark, sf)
    base = feat.premium_features(src, 1, relations.ORDERS_AS_OF, None, "all",
                                 extracts.streaming_counts(src, 1, relations.READER_AS_OF))
    return feat.features_by_segment(base, extracts.segment_lookup(src))


def normalised_tiers(spark, sf):
    # read by the fit and by the apply: keep the customer-grain tiers once
    t = tiers_3y(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    params = power.fit_power_standardise(t, RFMT)
    return power.apply_power_standardise(
        t.select(KEY, "Customer_Segment", "Segment_Order", *RFMT), params, RFMT)


def normalised_rfmts(spark, sf):
    f = rfmts_btc(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    return power.apply_power_standardise(f, power.fit_power_standardise(f, RFMTS), RFMTS)


def _round_cols(df, cols, nd=6):
    return df.select(*[F.round(F.col(c), nd).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------------- sources
def source_orders(spark, sf):
    return _src(spark, sf).order_fact


def orders_active_premium_3y(spark, sf):
    return extracts.orders_extract(_src(spark, sf), 3, relations.ORDERS_AS_OF)


def orders_active_premium_1y(spark, sf):
    return extracts.orders_extract(_src(spark, sf), 1, relations.ORDERS_AS_OF)


def orders_premium_any(spark, sf):
    return extracts.orders_extract(_src(spark, sf), 1, relations.ORDERS_AS_OF, require_active=False)


def orders_non_premium(spark, sf):
    return extracts.orders_non_premium(_src(spark, sf), 1, relations.ORDERS_AS_OF)


def streaming_counts(spark, sf):
    return extracts.streaming_counts(_src(spark, sf), 1, relations.READER_AS_OF)


def segment_lookup(spark, sf):
    return extracts.segment_lookup(_src(spark, sf))


def segment_lookup_one(spark, sf):
    return extracts.segment_lookup(_src(spark, sf), "BTC")


def cluster_label_counts(spark, sf):
    return profiles.label_counts(extracts.churn_labels(_src(spark, sf)), "RFM_cluster")


def snapshot_roundtrip(spark, sf):
    """Write the normalised tier table as CSV to the shared folder and read it
    back with an explicit schema (the reference's write_csv / read_csv)."""
    from custseg.sources.io import read_snapshot, write_snapshot
    df = normalised_tiers(spark, sf)
    tag = sf.rstrip("/").rsplit("/", 1)[-1]
    path = shared_path(spark, f"snapshots/normalised_{tag}_{_dt.date.today().isoformat()}.csv")
    write_snapshot(df, path)
    return _round_cols(read_snapshot(spark, path, df.schema), RFMT)


# ------------------------------------------------------------------ features
def order_lines(spark, sf):
    return _lines(spark, sf, 1)


def reference_date(spark, sf):
    return feat.reference_date(_lines(spark, sf, 1))


def _one_metric(metric):
    def q(spark, sf):
        # order-grain path (extract -> lines -> one group-by), kept as the
        # direct translation; the other queries aggregate before the join
        return feat.rfmt_features(_lines(spark, sf, 3), metrics=[metric])
    q.__name__ = metric.lower()
    return q


def rfmt_features(spark, sf):
    return features_3y(spark, sf)


def rolling_features(spark, sf):
    """The one-year features from daily state: a window of a month ago, then the new days."""
    src = _src(spark, sf)
    path = shared_path(spark, f"daily/orders-{uuid.uuid4().hex}")
    before = relations.ORDERS_AS_OF - _dt.timedelta(days=30)
    daily.build(path, src, before, 1, until=before)
    daily.refresh(path, src)
    return daily.features(path, src, relations.ORDERS_AS_OF, 1)


def rfmts_features(spark, sf):
    return rfmts_btc(spark, sf, "cohort")


def rfmts_features_all(spark, sf):
    return rfmts_btc(spark, sf, "all")


def rfmts_features_by_segment(spark, sf):
    return rfmts_all_segments(spark, sf)


def cohort_semi_join(spark, sf):
    src = _src(spark, sf)
    lines = feat.order_lines(extracts.orders_extract(src, 1, relations.ORDERS_AS_OF))
    return lines.join(extracts.segment_lookup(src, "BTC").select(KEY), KEY, "left_semi")


def cohort_bloom_semi_join(spark, sf):
    """The same cohort; orders outside it leave the fact by a Bloom filter, before any shuffle."""
    src = _src(spark, sf)
    keys = extracts.segment_lookup(src, "BTC").select(KEY)
    fact = membership.bloom_semi_join(src.order_fact, keys, KEY, keys_bound=1_000_000)
    return feat.order_lines(extracts.orders_extract(dataclasses.replace(src, order_fact=fact), 1, relations.ORDERS_AS_OF))


def rfmts_features_bucketed(spark, sf):
    """The BTC features from tables bucketed on the customer."""
    prefix = f"custseg_{uuid.uuid4().hex}"
    bucketed.build(_src(spark, sf), prefix, shared_path(spark, "bucketed"), buckets=16)
    return bucketed.premium_features(spark, prefix, relations.ORDERS_AS_OF, 1, "BTC", relations.READER_AS_OF)


ORDER_VALUE_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def order_value_quantiles(spark, sf):
    """Order values of premium customers per segment in the last year, from sketches kept by
    day: the days up to a month ago are written first, the later ones added."""
    src = _src(spark, sf)
    lines = extracts.orders_extract(src, 1, relations.ORDERS_AS_OF).join(extracts.segment_lookup(src), KEY).select(
        "Segment", F.col("DateOrdered_Key").alias("day"), "5_DB2")
    path = shared_path(spark, f"daily/order-values-{uuid.uuid4().hex}")
    first, before, last = (int((relations.ORDERS_AS_OF - _dt.timedelta(days=d)).strftime("%Y%m%d")) for d in (365, 30, 0))
    for part in (F.col("day") <= before, F.col("day") > before):
        sketch.put(sketch.sketch(lines.filter(part), ["Segment", "day"], "`5_DB2`"), path)
    q = sketch.quantiles(sketch.merged(spark, path, ["Segment"], first, last), ["Segment"], ORDER_VALUE_PROBS)
    names = [f"p{round(100 * p):02d}" for p in ORDER_VALUE_PROBS]
    return q.select("Segment", "n", *[F.round(f"q{j}", 6).alias(n) for j, n in enumerate(names)])


def tier_box_sketch(spark, sf):
    """Box statistics of the raw features per tier, quartiles within 1 % by sketch."""
    long = profiles.to_long(tiers_3y(spark, sf), [KEY, "Customer_Segment"], RFMT)
    return profiles.box_stats(long, "Customer_Segment", accuracy=sketch.ACCURACY)


def cohort_features(spark, sf):
    return cohorts.premium_cohort_features(_src(spark, sf), relations.ORDERS_AS_OF)


# ----------------------------------------------------------------- quartiles
def _quartile(metric):
    spec = scoring.QUARTILE_SPECS[metric]

    def q(spark, sf):
        f = features_3y(spark, sf)
        return scoring.add_quartiles(f.select(KEY, metric), [metric])
    q.__name__ = spec.out.lower()
    return q


def rfm_scores(spark, sf):
    f = features_3y(spark, sf)
    s = scoring.add_score(scoring.add_quartiles(f, RFMT), RFMT)
    return s.select(KEY, "R_Quantile", "F_Quantile", "M_Quantile", "T_Quantile",
                    "RFM_Segment", "Score")


def customer_tiers(spark, sf):
    return tiers_3y(spark, sf)


def rfmts_scores(spark, sf):
    return scoring.customer_tiers(rfmts_btc(spark, sf), RFMTS, scoring.TIERS_RFMTS)


# ----------------------------------------------------------------- summaries
def monetary_quartile_stats(spark, sf):
    return profiles.quartile_stats(tiers_3y(spark, sf))


def segment_code_sizes(spark, sf):
    return profiles.code_sizes(tiers_3y(spark, sf))


def tier_summary(spark, sf):
    return profiles.tier_summary(tiers_3y(spark, sf))


def tier_counts(spark, sf):
    return profiles.tier_counts(tiers_3y(spark, sf))


def relative_importance(spark, sf):
    return profiles.relative_importance(tiers_3y(spark, sf))


def feature_ranges(spark, sf):
    return profiles.feature_ranges(rfmts_btc(spark, sf), [KEY, *RFMTS])


def log_features_long(spark, sf):
    return profiles.log_features_long(tiers_3y(spark, sf))


def density_by_tier(spark, sf):
    return profiles.histogram_density(log_features_long(spark, sf), "Customer_Segment")


def kde_by_tier(spark, sf):
    return profiles.kernel_density(written(log_features_long(spark, sf), "density"), "Customer_Segment")


def legacy_normalise(spark, sf):
    return profiles.legacy_normalise(tiers_3y(spark, sf), RFMT, [KEY, "Customer_Segment"])


# ---------------------------------------------------------------- transforms
def yeo_johnson_lambda(spark, sf):
    lam = power.yeo_johnson_lambdas(rfmts_btc(spark, sf), RFMTS)
    return lam.select("metric", "lambda", F.round("loglik", 4).alias("loglik"), "n", "n_distinct")


def yeo_johnson_by_segment(spark, sf):
    lam = power.yeo_johnson_lambdas(rfmts_all_segments(spark, sf), RFMTS, ["Segment"])
    return lam.select("Segment", "metric", "lambda", F.round("loglik", 4).alias("loglik"),
                      "n", "n_distinct")


def yeo_johnson_apply(spark, sf):
    f = rfmts_btc(spark, sf)
    lam = {r["metric"]: r["lambda"] for r in power.yeo_johnson_lambdas(f, RFMTS).collect()}
    from custseg.functions.power import yeo_johnson
    return f.select(KEY, *[F.round(yeo_johnson(c, lam[c]), 6).alias(c) for c in RFMTS])


def standardise(spark, sf):
    f = rfmts_btc(spark, sf)
    params = power.fit_power_standardise(f, RFMTS, power=False)
    return _round_cols(power.apply_power_standardise(f, params, RFMTS), RFMTS)


def normalised_features(spark, sf):
    return _round_cols(normalised_rfmts(spark, sf), RFMTS)


def normalised_tiers_q(spark, sf):
    return _round_cols(normalised_tiers(spark, sf), RFMT)


def normalised_by_segment(spark, sf):
    f = rfmts_all_segments(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    params = power.fit_power_standardise(f, RFMTS, ["Segment"])
    return _round_cols(power.apply_power_standardise(f, params, RFMTS, ["Segment"]), RFMTS)


def tier_profile(spark, sf):
    return profiles.profile_long(normalised_tiers(spark, sf), "Customer_Segment", RFMT)


def tier_profile_wide(spark, sf):
    return profiles.profile_wide(tier_profile(spark, sf), "Customer_Segment", RFMT)


def clip_outliers(spark, sf):
    return _round_cols(profiles.clip(normalised_tiers(spark, sf), "Monetary", -3, 3), RFMT)


def density_normalised(spark, sf):
    n = profiles.clip(normalised_tiers(spark, sf), "Monetary", -3, 3)
    long = profiles.to_long(n, [KEY, "Customer_Segment"], RFMT, "name", "value")
    return profiles.histogram_density(long, "Customer_Segment")


def kde_normalised(spark, sf):
    n = profiles.clip(normalised_tiers(spark, sf), "Monetary", -3, 3)
    long = profiles.to_long(n, [KEY, "Customer_Segment"], RFMT, "name", "value")
    return profiles.kernel_density(written(long, "density"), "Customer_Segment")


# ------------------------------------------------- fixed (data-derived) centres
def _tier_centres(spark, sf):
    n = normalised_tiers(spark, sf)
    centres, ids = clusters.centers_by_group(n, RFMT, "Customer_Segment", "Segment_Order")
    return n, centres, ids


def assign_nearest_centroid(spark, sf):
    n, centres, ids = _tier_centres(spark, sf)
    pos = clusters.nearest_cluster(RFMT, centres)
    return n.select(KEY, F.element_at(F.array(*[F.lit(i) for i in ids]), pos).alias("Cluster"))


def _assigned(spark, sf):
    n, centres, ids = _tier_centres(spark, sf)
    pos = clusters.nearest_cluster(RFMT, centres)
    return n.withColumn("_pos", pos), centres, ids


def within_sse(spark, sf):
    a, centres, ids = _assigned(spark, sf)
    d = clusters.sq_dist_to(RFMT, centres, F.col("_pos"))
    cl = F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("_pos"))
    return a.groupBy(cl.alias("Cluster")).agg(F.count(F.lit(1)).alias("n"),
                                              F.round(F.sum(d), 6).alias("sse"))


def cluster_means(spark, sf):
    a, _c, ids = _assigned(spark, sf)
    a = a.withColumn("Cluster", F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("_pos")))
    return profiles.profile_long(a, "Cluster", RFMT)


def cluster_box_stats(spark, sf):
    a, _c, ids = _assigned(spark, sf)
    a = a.withColumn("Cluster", F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("_pos")))
    long = profiles.to_long(a, [KEY, "Cluster"], RFMT)
    return profiles.box_stats(long, "Cluster", value_range=(-5.0, 5.0))


# ------------------------------------------------------------- k-means fits
def _auto(spark, sf):
    data = written(normalised_rfmts(spark, sf), "normalised")
    return data, *clusters.auto_k(data, RFMTS)


def _fixed(spark, sf):
    data = written(normalised_rfmts(spark, sf), "normalised")
    model = clusters.fixed_k(data, RFMTS, clusters.FIXED_K, standardize=True)
    return data, model


def _sizes(labelled):
    return labelled.groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))


def _tidy(centroids):
    # centres of few rows end in half a millionth: 1e-9 sends every engine the same way
    return centroids.withColumn("value", F.round(F.col("value") + F.lit(1e-9), 6))


def _centroids(spark, model):
    return _tidy(cohorts.centroid_table(spark, model, RFMTS))


def kmeans_auto_k(spark, sf):
    data, model, _curve = _auto(spark, sf)
    return _round_cols(model.predict(data), RFMTS)


def auto_k_curve(spark, sf):
    _data, _model, curve = _auto(spark, sf)
    return spark.createDataFrame(curve, "k int, sse double")


def kmeans_fixed_k(spark, sf):
    data, model = _fixed(spark, sf)
    return _round_cols(model.predict(data, [KEY, *RFMTS]), RFMTS)


def cluster_sizes(spark, sf):
    data, model, _curve = _auto(spark, sf)
    return _sizes(model.predict(data))


def cluster_profile(spark, sf):
    _data, model, _curve = _auto(spark, sf)
    return _centroids(spark, model)


def fixed_k_sizes(spark, sf):
    data, model = _fixed(spark, sf)
    return _sizes(model.predict(data))


def fixed_k_profile(spark, sf):
    _data, model = _fixed(spark, sf)
    return _centroids(spark, model)


def fixed_k_box_stats(spark, sf):
    """The boxes of the many-cluster model, without axis limits."""
    data, model = _fixed(spark, sf)
    return profiles.box_stats(profiles.to_long(model.predict(data), [KEY, "Cluster"], RFMTS), "Cluster")


def scree_curve(spark, sf):
    data = written(normalised_rfmts(spark, sf), "normalised")
    curve = clusters.scree_curve(data, RFMTS, fold=F.pmod(F.col(KEY), F.lit(clusters.SCREE_FOLDS)))
    return spark.createDataFrame(curve, "k int, wss double")


def score_customers(spark, sf):
    from custseg.sources.io import dated_path
    return _round_cols(cohorts.train_save_score(spark, rfmts_btc(spark, sf), RFMTS, dated_path(
        shared_path(spark, "models"), "rfmts_kmeans_model")), RFMTS)


def score_refit(spark, sf):
    """The non-segment customers scored by the stored model of the segment, the
    transform re-fitted on them (the scoring script)."""
    path = shared_path(spark, f"models/refit-{uuid.uuid4().hex}")
    cohorts.train(rfmts_btc(spark, sf), RFMTS, path)
    everyone = rfmts_all_segments(spark, sf).filter(F.col("Segment") != "BTC").select(KEY, *RFMTS)
    return _round_cols(cohorts.score(path, everyone, RFMTS, refit=True), RFMTS)


def export_roundtrip(spark, sf):
    """Scores exported for a day and read back (the scoring script's table)."""
    from custseg.sources.io import export_scores
    path = shared_path(spark, f"exports/scores-{uuid.uuid4().hex}")
    data, model = _fixed(spark, sf)
    export_scores(model.predict(data, [KEY]), path, relations.ORDERS_AS_OF)
    return spark.read.parquet(path).select(KEY, "Cluster", F.col("as_of").cast("date").alias("as_of"))


def model_roundtrip_scores(spark, sf):
    return cohorts.model_roundtrip(spark, rfmts_btc(spark, sf), RFMTS,
                                   shared_path(spark, "models/roundtrip"))


def sample_clustered(spark, sf):
    data = written(normalised_tiers(spark, sf), "normalised")
    model, _ = clusters.auto_k(data, RFMT)
    pred = model.predict(data)
    from custseg.operators.quantiles import exact_sample
    return exact_sample(profiles.clip(pred, "Monetary", -5, 5), 0.2, 42, KEY)


def best_cluster_members(spark, sf):
    return cohorts.best_cluster_members(rfmts_btc(spark, sf, "all"), RFMTS)


def nested_clusters(spark, sf):
    return _round_cols(cohorts.nested_clusters(rfmts_btc(spark, sf, "all"), RFMTS), RFMTS)


def segment_clusters(spark, sf):
    return _round_cols(cohorts.segment_clusters(rfmts_all_segments(spark, sf), RFMTS), RFMTS)


def segment_profiles(spark, sf, value_range=None):
    """Per segment: mean normalised metric per cluster (the centroid lines of
    the per-segment plots).  All points; ``value_range=(-2, 2)`` drops those
    outside the plot's ylim."""
    sc = segment_clusters(spark, sf)
    return profiles.profile_long(sc, "Cluster", RFMTS, extra_group=("Segment",),
                                 value_range=value_range)


def segment_box_stats(spark, sf):
    """Per segment: box statistics per cluster and metric within ±5."""
    sc = segment_clusters(spark, sf).withColumn("Group", F.concat_ws("/", "Segment",
                                                                     F.col("Cluster").cast("string")))
    long = profiles.to_long(sc, [KEY, "Group"], RFMTS)
    return profiles.box_stats(long, "Group", value_range=(-5.0, 5.0))


def cohort_comparison(spark, sf):
    return _tidy(cohorts.cohort_comparison(spark, _src(spark, sf), relations.ORDERS_AS_OF))


def queries() -> dict[str, Query]:
    q = {
        # sources and extracts
        "source_orders": source_orders,
        "orders_active_premium_3y": orders_active_premium_3y,
        "orders_active_premium_1y": orders_active_premium_1y,
        "orders_premium_any": orders_premium_any,
        "orders_non_premium": orders_non_premium,
        "streaming_counts": streaming_counts,
        "segment_lookup": segment_lookup,
        "segment_lookup_one": segment_lookup_one,
        "cluster_label_counts": cluster_label_counts,
        "snapshot_roundtrip": snapshot_roundtrip,
        # features
        "order_lines": order_lines,
        "reference_date": reference_date,
        "recency": _one_metric("RecencyDays"),
        "frequency": _one_metric("Frequency"),
        "monetary": _one_metric("Monetary"),
        "tenure": _one_metric("Tenure"),
        "rfmt_features": rfmt_features,
        "rolling_features": rolling_features,
        "rfmts_features_bucketed": rfmts_features_bucketed,
        "cohort_bloom_semi_join": cohort_bloom_semi_join,
        "order_value_quantiles": order_value_quantiles,
        "tier_box_sketch": tier_box_sketch,
        "rfmts_features": rfmts_features,
        "rfmts_features_all": rfmts_features_all,
        "rfmts_features_by_segment": rfmts_features_by_segment,
        "cohort_semi_join": cohort_semi_join,
        "cohort_features": cohort_features,
        # quartiles, scores, tiers
        "r_quartile": _quartile("RecencyDays"),
        "f_quartile": _quartile("Frequency"),
        "m_quartile": _quartile("Monetary"),
        "t_quartile": _quartile("Tenure"),
        "rfm_scores": rfm_scores,
        "customer_tiers": customer_tiers,
        "rfmts_scores": rfmts_scores,
        # summaries
        "monetary_quartile_stats": monetary_quartile_stats,
        "segment_code_sizes": segment_code_sizes,
        "tier_summary": tier_summary,
        "tier_counts": tier_counts,
        "relative_importance": relative_importance,
        "feature_ranges": feature_ranges,
        "log_features_long": log_features_long,
        "density_by_tier": density_by_tier,
        "kde_by_tier": kde_by_tier,
        "legacy_normalise": legacy_normalise,
        # transforms and profiles
        "yeo_johnson_lambda": yeo_johnson_lambda,
        "yeo_johnson_by_segment": yeo_johnson_by_segment,
        "yeo_johnson_apply": yeo_johnson_apply,
        "standardise": standardise,
        "normalised_features": normalised_features,
        "normalised_tiers": normalised_tiers_q,
        "normalised_by_segment": normalised_by_segment,
        "tier_profile": tier_profile,
        "tier_profile_wide": tier_profile_wide,
        "clip_outliers": clip_outliers,
        "density_normalised": density_normalised,
        "kde_normalised": kde_normalised,
        # clustering arithmetic on fixed, data-derived centres
        "assign_nearest_centroid": assign_nearest_centroid,
        "within_sse": within_sse,
        "cluster_means": cluster_means,
        "cluster_box_stats": cluster_box_stats,
        # k-means fits
        "kmeans_auto_k": kmeans_auto_k,
        "auto_k_curve": auto_k_curve,
        "kmeans_fixed_k": kmeans_fixed_k,
        "cluster_sizes": cluster_sizes,
        "cluster_profile": cluster_profile,
        "fixed_k_sizes": fixed_k_sizes,
        "fixed_k_profile": fixed_k_profile,
        "fixed_k_box_stats": fixed_k_box_stats,
        "scree_curve": scree_curve,
        "score_refit": score_refit,
        "export_roundtrip": export_roundtrip,
        "score_customers": score_customers,
        "model_roundtrip_scores": model_roundtrip_scores,
        "sample_clustered": sample_clustered,
        "best_cluster_members": best_cluster_members,
        "nested_clusters": nested_clusters,
        "segment_clusters": segment_clusters,
        "segment_profiles": segment_profiles,
        "segment_box_stats": segment_box_stats,
        "cohort_comparison": cohort_comparison,
    }
    return q

