"""Cohort-level workflows: premium vs non-premium, per segment, nested
clustering, model persistence and scoring.

Segments and cohorts are groups of one fit: λ, mean and SD come from one grouped
job, and the k-means of all groups advance together (``operators.lloyd``), each
with its own k.  The number of jobs does not depend on the number of groups.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.operators import clusters, lloyd, power, profiles
from custseg.operators import features as feat
from custseg.session import written
from custseg.sources import extracts

KEY = "Customer_Key"


def premium_cohort_features(src, as_of, segment: str = "BTC") -> DataFrame:
    """RFM per customer for the premium cohort (any IsActive) and the
    non-premium cohort, each with its own reference date (max of the cohort,
    before the segment filter), restricted to ``segment``; long by cohort."""
    seg = extracts.segment_lookup(src)
    out = None
    cohorts_ = (("premium", feat.order_aggregates_premium(src, 1, as_of, require_active=False)),
                ("non_premium", feat.order_aggregates_non_premium(src, 1, as_of)))
    for name, agg in cohorts_:
        # reference date = max of the cohort, before the segment filter
        f = feat.features_from_aggregates(agg, "frame", metrics=feat.RFM)
        f = f.join(seg, KEY, "inner").filter(F.col("Segment") == segment)
        f = f.select(F.lit(name).alias("cohort"), KEY, *feat.RFM, "Segment")
        out = f if out is None else out.unionByName(f)
    return out


def centroid_table(spark: SparkSession, model, cols: list[str]) -> DataFrame:
    """Centroids in long form: ``Cluster, metric, metric_order, value``."""
    rows = [(i + 1, c, profiles.METRIC_ORDER.get(c), float(v))
            for i, centre in enumerate(model.centers()) for c, v in zip(cols, centre)]
    return spark.createDataFrame(rows, "Cluster int, metric string, metric_order int, value double")


def normalise_and_cluster(features: DataFrame, cols: list[str], keep: list[str] | None = None):
    """Fit the transform on ``features`` itself, then auto-k k-means.
    Returns (prepared normalised rows, Clustering)."""
    keep = keep or [KEY]
    params = power.fit_power_standardise(features, cols)
    norm = power.apply_power_standardise(features.select(*keep, *cols), params, cols)
    data = written(norm, "normalised")
    model, _ = clusters.auto_k(data, cols)
    return data, model


def grouped_clusters(features: DataFrame, cols: list[str], group_cols: list[str],
                     k_max: int = clusters.AUTO_K_MAX, max_iter: int = clusters.DEFAULT_MAX_ITER,
                     state_bytes: int = lloyd.STATE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Transform and automatic k within every group at once.  Returns the normalised
    rows and one model a group (``_g, f, k, n, sse, centres, fill``); centres are in id
    order.  A NULL group is a group."""
    params = power.fit_power_standardise(features, cols, group_cols)
    norm = written(power.apply_power_standardise(features, params, cols, group_cols), "normalised")
    models = lloyd.fit(norm, cols, list(range(1, k_max + 1)), max_iter, group_cols, state_bytes=state_bytes)
    best = lloyd.growing_k(models, len(cols)).withColumn(
        "centres", lloyd.ranked(F.col("centres"), clusters.score_sign(cols)))
    return norm, best


def best_cluster_members(features: DataFrame, cols: list[str],
                         cluster_id: int | None = None) -> DataFrame:
    """Raw features of the members of the best cluster (id 1 after the
    deterministic relabelling, or ``cluster_id``)."""
    data, model = normalise_and_cluster(features, cols)
    pred = model.predict(data, [KEY])
    target = 1 if cluster_id is None else cluster_id
    members = pred.filter(F.col("Cluster") == target).select(KEY)
    return features.join(members, KEY, "left_semi")


def nested_clusters(features: DataFrame, cols: list[str]) -> DataFrame:
    """Second-stage clustering inside the best cluster: the transform is
    re-fitted on the members, then auto-k again.  ``Customer_Key, Cluster``."""
    members = best_cluster_members(features, cols)
    data, model = normalise_and_cluster(members, cols)
    return model.predict(data, [KEY, *cols])


def segment_clusters(features: DataFrame, cols: list[str], state_bytes: int = lloyd.STATE_BYTES) -> DataFrame:
    """Transform and automatic-k k-means within each segment, a NULL segment included.
    ``Segment, Customer_Key, Cluster, metrics``."""
    norm, models = grouped_clusters(features.select("Segment", KEY, *cols), cols, ["Segment"],
                                    state_bytes=state_bytes)
    return lloyd.label(norm, cols, models, clusters.AUTO_K_MAX, ["Segment", KEY, *cols], ["Segment"])


def cohort_comparison(spark: SparkSession, src, as_of, segment: str = "BTC") -> DataFrame:
    """Premium vs non-premium: RFM normalised per cohort, auto-k per cohort,
    centroid profiles side by side (``cohort, Cluster, metric, …``)."""
    feats = premium_cohort_features(src, as_of, segment)
    _norm, models = grouped_clusters(feats.select("cohort", KEY, *feat.RFM), feat.RFM, ["cohort"])
    centre = models.select(F.from_json("_g", "cohort string")["cohort"].alias("cohort"),
                           F.posexplode("centres").alias("i", "c"))
    long = centre.select("cohort", (F.col("i") + 1).cast("int").alias("Cluster"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), (F.col("c")[j] / lloyd.SCALE).alias("value"))
        for j, c in enumerate(feat.RFM)])).alias("m"))
    return long.select("cohort", "Cluster", "m.metric", profiles.metric_order("m.metric").alias("metric_order"),
                       "m.value")


def fitted_transform(features: DataFrame, cols: list[str]) -> power.YeoJohnsonScalerModel:
    """The normalisation of ``cols``, in place, fitted on ``features``."""
    params = {r["metric"]: r for r in power.fit_power_standardise(features, cols).collect()}

    def value(c, name):
        v = params[c][name] if c in params else None
        return float("nan") if v is None else float(v)
    return power.YeoJohnsonScalerModel(inputCols=cols, outputCols=cols, lambdas=[value(c, "lambda") for c in cols],
                                       means=[value(c, "mean") for c in cols], sds=[value(c, "sd") for c in cols])


def fitted_pipeline(features: DataFrame, cols: list[str]) -> PipelineModel:
    """Fit the transform and auto-k k-means once and assemble them into one
    persistable ``PipelineModel``: transform in place, then the 1-based ``Cluster``
    of the nearest centre (a missing metric takes the training mean)."""
    scaler = fitted_transform(features, cols)
    data = written(scaler.transform(features.select(KEY, *cols)), "normalised")
    model, _ = clusters.auto_k(data, cols)
    return PipelineModel(stages=[scaler, model.stage()])


def train(features: DataFrame, cols: list[str], path: str) -> None:
    """Fit on ``features`` and save the whole scoring pipeline to ``path``."""
    fitted_pipeline(features, cols).write().overwrite().save(path)


def score(path: str, features: DataFrame, cols: list[str], refit: bool = False) -> DataFrame:
    """Score ``features`` with the pipeline stored at ``path``, in any session: one
    row per customer, ``Customer_Key, Cluster, metrics``.  ``refit=True`` re-fits
    the transform on the scoring data, as the reference's scoring script does."""
    model = PipelineModel.load(path)
    if refit:               # the transform alone: one fit of λ, mean and SD, no k-means
        model = PipelineModel(stages=[fitted_transform(features, cols), *model.stages[1:]])
    return model.transform(features.select(KEY, *cols)).select(KEY, F.col("Cluster").cast("int"), *cols)


def train_save_score(spark: SparkSession, features: DataFrame, cols: list[str], path: str,
                     refit: bool = False) -> DataFrame:
    """Train, save to ``path``, load it back and score the same customers."""
    train(features, cols, path)
    return score(path, features, cols, refit)


def model_roundtrip(spark: SparkSession, features: DataFrame, cols: list[str], path: str
                    ) -> DataFrame:
    """Predictions before and after save/load: ``Customer_Key, Cluster,
    Cluster_loaded`` (they must be equal on every row)."""
    model = fitted_pipeline(features, cols)
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = model.transform(features).select(KEY, F.col("Cluster").cast("int"))
    b = loaded.transform(features).select(KEY, F.col("Cluster").cast("int").alias("Cluster_loaded"))
    return a.join(b, KEY)
