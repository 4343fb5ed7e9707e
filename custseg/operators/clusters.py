"""k-means on the normalised features.

* ``auto_k``         grow k and stop when the relative drop of the within-SSE
                     falls below ``min(0.02 + 10/n + 2.5/p², 0.8)``
* ``fixed_k``        fixed k, optionally standardised
* ``scree_curve``    k = 1..16, 5-fold cross-validated held-out SSE
* ``fit_kmeans``     Spark ML's seeded k-means||, for pipelines that want it
* ``assign_nearest`` / ``within_sse`` / ``cluster_means`` for given centroids

The first three use ``operators.lloyd``: all k (and all folds) advance together,
one pass over the rows a step, with the same centres on any cluster.  Cluster ids
follow the centres: 1 = highest ``F + M + T + S - R`` centroid score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.operators import lloyd, power
from custseg.session import ensure_checkpoint_dir

KEY = "Customer_Key"
SEED = 42                   # ours: the reference passes no seed

# fixed values (must equal the reference's k-means calls):
DEFAULT_MAX_ITER = 10       # default iteration cap of its k-means
AUTO_K_MAX = 10             # k limit of the automatic-k model
FIXED_K = 7                 # the fixed-k, standardised model
SCREE_K = 16                # scree curve k = 1..16
SCREE_FOLDS = 5             # 5-fold cross-validation
SCREE_MAX_ITER = 25         # iteration cap of the scree fits


ROWS_PER_PARTITION = 500_000   # ~20-40 MB of feature rows per k-means task


def partitions_for(spark, rows: int) -> int:
    """Default partition count for ``rows`` feature rows; it follows the data
    alone, not the session's settings.  ``prepare`` takes an explicit count."""
    return max(1, -(-rows // ROWS_PER_PARTITION))


def prepare(df: DataFrame, partitions: int | None = None, key: str = KEY) -> DataFrame:
    """Checkpoint the feature rows, range-partitioned and sorted by key.  The
    partition count follows the data size (every k-means iteration launches
    one task per partition)."""
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or partitions_for(df.sparkSession, df.count())
    laid = df.repartitionByRange(n, key).sortWithinPartitions(key) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    # the checkpoint is the recovery point; the in-memory copy serves the
    # repeated k-means passes
    cut = laid.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
    laid.unpersist()
    return cut


def score_sign(cols: list[str]) -> list[float]:
    return [-1.0 if c.lower().startswith("recency") else 1.0 for c in cols]


@dataclass
class Clustering:
    """A fitted model: centres (in id order) and fill values in millionths."""
    cols: list[str]
    scaled: list[list[float]]
    fill: list[float]
    cost: float
    mean: list[float] | None = None     # of a standardised model
    sd: list[float] | None = None

    @property
    def k(self) -> int:
        return len(self.scaled)

    def centers(self) -> list[list[float]]:
        """Centroids in input units (standardisation undone), ordered by id."""
        out = [[v / lloyd.SCALE for v in c] for c in self.scaled]
        if self.mean is not None:
            out = [[v * (s or 1.0) + m for v, m, s in zip(c, self.mean, self.sd)] for c in out]
        return out

    def _input(self, j: int) -> str:
        x = f"nanvl(CAST(`{self.cols[j]}` AS DOUBLE), CAST(NULL AS DOUBLE))"
        if self.mean is None:
            return x
        return f"({x} - {self.mean[j]!r}D) / {self.sd[j]!r}D" if self.sd[j] else f"{x} * 0D"

    def expression(self) -> str:
        """The cluster id as SQL text, so that a saved pipeline can hold it."""
        x = [f"coalesce(round(CASE WHEN abs({self._input(j)}) < double('infinity') THEN {self._input(j)} END "
             f"* {float(lloyd.SCALE)!r}D), {self.fill[j]!r}D)" for j in range(len(self.cols))]
        options = []
        for i, c in enumerate(self.scaled):
            d = " + ".join(f"({x[j]} - ({v!r}D)) * ({x[j]} - ({v!r}D))" for j, v in enumerate(c))
            options.append(f"struct({d} AS d, {i + 1} AS id)")
        return f"array_min(array({', '.join(options)})).id"

    def stage(self) -> SQLTransformer:
        return SQLTransformer(statement=f"SELECT *, {self.expression()} AS Cluster FROM __THIS__")

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns + ``Cluster`` (1-based)."""
        keep = keep if keep is not None else df.columns
        return df.select(*keep, F.expr(self.expression()).cast("int").alias("Cluster"))


def _clustering(row, cols: list[str], mean=None, sd=None) -> Clustering:
    centres = [list(map(float, c)) for c in row["centres"]]
    signs = score_sign(cols)
    if mean is not None:                # ids follow the centres in input units
        units = [[v * (d or 1.0) + m * lloyd.SCALE for v, m, d in zip(c, mean, sd)] for c in centres]
    else:
        units = centres
    order = sorted(range(len(centres)), key=lambda i: (-sum(s * v for s, v in zip(signs, units[i])), i))
    return Clustering(cols, [centres[i] for i in order], list(map(float, row["fill"])), float(row["sse"]), mean, sd)


def fill_stage(df: DataFrame, cols: list[str]) -> SQLTransformer:
    """Copies ``_f_<col>`` of the metrics with NULL and NaN replaced by the column's
    mean (0 where it has none), so that every customer keeps its row; a missing
    metric then adds nothing to the distance within the column."""
    row = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c)
                   for c in cols]).collect()[0]
    filled = ", ".join(
        f"coalesce(nanvl(double(`{c}`), double(NULL)), {float(row[c] or 0.0)!r}D) AS `_f_{c}`" for c in cols)
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def _vector_stages(df: DataFrame, cols: list[str]) -> list:
    return [fill_stage(df, cols),
            VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol="_raw")]


def assembled_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    out = df
    for stage in _vector_stages(df, cols):
        out = stage.transform(out)
    return out


def _means(df: DataFrame, cols: list[str]) -> list[float]:
    row = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c)
                   for c in cols]).collect()[0]
    return [float(row[c] or 0.0) for c in cols]


def one_cluster(df: DataFrame, cols: list[str], cost: float) -> Clustering:
    """The k = 1 model: everybody in cluster 1, the column means as its centre."""
    mean = [v * lloyd.SCALE for v in _means(df, cols)]
    return Clustering(cols, [mean], mean, cost)


def total_ss(df: DataFrame, cols: list[str]) -> float:
    """Within-SSE of one cluster (the k = 1 model): Σ over columns of
    n · var_pop; exact, one aggregate."""
    row = df.agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in cols]).collect()[0]
    return float(sum(row[c] or 0.0 for c in cols))


def fit_kmeans(df: DataFrame, cols: list[str], k: int, seed: int = SEED,
               max_iter: int = DEFAULT_MAX_ITER, standardize: bool = False,
               assembled: DataFrame | None = None, n_init: int = 1) -> Clustering:
    """Spark ML k-means on ``cols``; ``assembled`` (``df`` with the ``_raw`` vector
    column, ideally persisted) lets a loop of fits share one assembly.
    ``n_init > 1`` fits seeds ``seed, seed+1, …`` and keeps the lowest SSE
    (fewer bad local optima, at n_init times the cost)."""
    if n_init > 1:
        fits = [fit_kmeans(df, cols, k, seed + i, max_iter, standardize, assembled)
                for i in range(n_init)]
        return min(fits, key=lambda m: m.cost)
    if standardize:
        model = Pipeline(stages=[
            *_vector_stages(df, cols),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
            KMeans(featuresCol="_features", k=k, seed=seed, maxIter=max_iter,
                   predictionCol="prediction")]).fit(df)
    else:
        data = assembled if assembled is not None else assembled_rows(df, cols)
        km = KMeans(featuresCol="_raw", k=k, seed=seed, maxIter=max_iter,
                    predictionCol="prediction").fit(data)
        model = PipelineModel(stages=[*_vector_stages(df, cols), km])
    km = model.stages[-1]
    centres = [[float(v) * lloyd.SCALE for v in c] for c in km.clusterCenters()]
    found = {"centres": centres, "sse": km.summary.trainingCost}
    if not standardize:
        return _clustering({**found, "fill": [v * lloyd.SCALE for v in _means(df, cols)]}, cols)
    scaler = model.stages[-2]
    return _clustering({**found, "fill": [0.0] * len(cols)}, cols, list(map(float, scaler.mean.toArray())),
                       list(map(float, scaler.std.toArray())))


def auto_k(df: DataFrame, cols: list[str], k_max: int = AUTO_K_MAX, max_iter: int = DEFAULT_MAX_ITER
           ) -> tuple[Clustering, list[tuple[int, float]]]:
    """Grow k from 1; keep k while the relative SSE drop stays at or above
    ``min(0.02 + 10/n + 2.5/p², 0.8)``.  Returns the chosen model and the
    (k, SSE) curve up to the k that stopped it.  An empty ``df`` has one centre
    at 0 and SSE 0."""
    models = lloyd.fit(df, cols, list(range(1, k_max + 1)), max_iter)
    rows = models.orderBy("k").collect()                   # k_max rows
    if not rows:
        return Clustering(cols, [[0.0] * len(cols)], [0.0] * len(cols), 0.0), [(1, 0.0)]
    best = lloyd.growing_k(models, len(cols)).collect()[0]
    last = min(best["k"] + 1, k_max, max(best["n"], 1))
    return _clustering(best, cols), [(r["k"], float(r["sse"])) for r in rows if r["k"] <= last]


def fixed_k(df: DataFrame, cols: list[str], k: int = FIXED_K, max_iter: int = DEFAULT_MAX_ITER,
            standardize: bool = False) -> Clustering:
    """The model of exactly ``k`` centres (fewer where there are fewer distinct rows)."""
    mean = sd = None
    data = df
    if standardize:
        params = power.fit_power_standardise(df, cols, power=False)
        rows = {r["metric"]: r for r in params.collect()}  # one row a metric
        mean = [float(rows[c]["mean"] or 0.0) if c in rows else 0.0 for c in cols]
        sd = [float(rows[c]["sd"] or 0.0) if c in rows else 0.0 for c in cols]
        data = power.apply_power_standardise(df, params, cols) if len(rows) == len(cols) else df
    found = lloyd.fit(data, cols, [k], max_iter).collect()
    if not found:
        return Clustering(cols, [[0.0] * len(cols)], [0.0] * len(cols), 0.0)
    return _clustering(found[0], cols, mean, sd)


def scree_curve(df: DataFrame, cols: list[str], k_max: int = SCREE_K, folds: int = SCREE_FOLDS,
                max_iter: int = SCREE_MAX_ITER, key: str = KEY, fold: Column | None = None
                ) -> list[tuple[int, float]]:
    """Cross-validated within-SSE for k = 1..k_max: each fold is held out of one set
    of models and scored by it; the held-out SSEs are summed.  ``fold`` defaults to
    ``pmod(xxhash64(key), folds)``.  All k and folds advance together: k_max + max_iter
    passes over the rows.  Every customer counts: a missing metric takes the mean of
    the rows fitted on."""
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(folds)) if fold is None else fold
    models = lloyd.fit(df, cols, list(range(1, k_max + 1)), max_iter, fold=fold, folds=folds)
    got = models.groupBy("k").agg(F.sum(F.round(F.col("sse") * lloyd.SSE_SCALE).cast("long")).alias("s")).collect()
    return sorted((r["k"], r["s"] / lloyd.SSE_SCALE) for r in got)


def sq_dist_to(cols: list[str], centers: list[list[float]], cluster: Column) -> Column:
    """Squared distance of the row to centre ``cluster`` (1-based)."""
    arrs = [F.array(*[F.lit(float(c[j])) for c in centers]) for j in range(len(cols))]
    d = None
    for j, col in enumerate(cols):
        diff = F.col(col) - F.element_at(arrs[j], cluster)
        d = diff * diff if d is None else d + diff * diff
    return d


def nearest_cluster(cols: list[str], centers: list[list[float]]) -> Column:
    """1-based id of the nearest centre (ties -> lowest id); a pure column
    expression, no join of points with centres."""
    cands = []
    for i, c in enumerate(centers):
        d = None
        for col, v in zip(cols, c):
            diff = F.col(col) - F.lit(float(v))
            d = diff * diff if d is None else d + diff * diff
        cands.append(F.struct(d.alias("d"), F.lit(i + 1).alias("id")))
    return F.array_min(F.array(*cands))["id"]


def centers_by_group(df: DataFrame, cols: list[str], group_col: str, order_col: str) -> list:
    """Mean of ``cols`` per group, ordered by ``order_col`` (k rows to the driver)."""
    rows = df.groupBy(group_col, order_col).agg(*[F.avg(c).alias(c) for c in cols]) \
        .orderBy(order_col).collect()
    return [[float(r[c]) for c in cols] for r in rows], [r[order_col] for r in rows]

