"""Yeo-Johnson power transform + centring/scaling, fitted on Spark.

λ maximises the profile log-likelihood
    ll(λ) = -n/2 · ln(var(yj(x, λ))) + (λ - 1) · Σ sign(x)·ln(|x| + 1)
on [-5, 5].  Everything is read from one histogram per (group…, metric):
``groupBy(group…, metric, x).count``, written once, so days and counts shrink to
their few distinct values and n, the distinct count and all moments are weighted
sums over it.  The search narrows a grid (0.1 → 0.01 → 0.001); a level evaluates
101 or 21 candidates per distinct value, not per row, with map-side partial
sums, and the levels are one lazy plan.  Moments
are taken about a value of the column itself (its approximate median), which
keeps them stable at large |λ| and exactly zero for a constant.
A metric with fewer than 5 distinct values, or whose λ lands within 0.001 of
a limit, is left untransformed (NULL λ).

``fit_power_standardise`` returns the per-(group, metric) parameter table;
``apply_power_standardise`` joins it back.  Parameter tables are written files
and joined without a hint: Spark broadcasts them only below
``autoBroadcastJoinThreshold`` and otherwise splits hot keys (AQE).
``YeoJohnsonScaler`` is the same fit as a Spark ML Estimator, so that it can
sit in a ``Pipeline`` with ``VectorAssembler`` and ``KMeans`` and be saved.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.functions.power import YJ_EPS, YJ_LIMITS, YJ_MIN_UNIQUE, yeo_johnson
from custseg.session import written

# search settings (ours, not the reference's): grid steps in thousandths of λ,
# half-width of a refinement window in steps, variance guard
_LEVELS = (100, 10, 1)          # λ step = level/1000
_HALF = 10
_VAR_GUARD = 1e-12


def to_long(df: DataFrame, cols: list[str], group_cols: list[str] | tuple = ()) -> DataFrame:
    """``(group…, metric, x)`` with NULL x removed (one Expand, no union)."""
    wide = df.select(*group_cols, *[F.col(c).cast("double").alias(c) for c in cols])
    ids = list(group_cols)
    return wide.unpivot(ids, cols, "metric", "x").filter(F.col("x").isNotNull()) \
        if ids else wide.withColumn("_one", F.lit(1)).unpivot(
            ["_one"], cols, "metric", "x").drop("_one").filter(F.col("x").isNotNull())


def _histogram(df: DataFrame, cols: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``keys…, x, w, x0, const`` (w rows have the value x; x0 is the value the moments
    are taken about, const the sum in the likelihood) and ``keys…, n, n_distinct``."""
    hist = written(to_long(df, cols, keys[:-1]).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w")),
                   "power-histogram")
    stats = written(hist.groupBy(*keys).agg(
        F.sum("w").alias("n"), F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.col("w") * F.signum("x") * F.log1p(F.abs("x"))).alias("const"),
        F.percentile_approx("x", 0.5).alias("x0")), "power-statistics")
    return written(_joined(hist, stats.select(*keys, "x0", "const"), keys), "power-values"), \
        stats.drop("x0", "const")


def _moments(rows: DataFrame, keys: list[str], y0: str = "_y0") -> DataFrame:
    """``keys…, _n, _mean, _ss`` of ``_y`` weighted by ``w``, taken about ``y0``."""
    d = F.col("_y") - F.col(y0)
    n, one, two = F.col("_n"), F.col("_d1"), F.col("_d2")
    return rows.groupBy(*keys, y0).agg(
        F.sum("w").alias("_n"), F.sum(F.col("w") * d).alias("_d1"), F.sum(F.col("w") * d * d).alias("_d2")) \
        .select(*keys, "_n", (F.col(y0) + one / n).alias("_mean"),
                F.greatest(two - one * one / n, F.lit(0.0)).alias("_ss"))


def _loglik(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Max-likelihood candidate per key; ``cands`` holds the histogram's columns and
    ``_c`` (λ in thousandths), one row per (distinct value, candidate)."""
    lam = F.col("_c") / F.lit(1000.0)
    ev = _moments(cands.select(*keys, "_c", "const", "w", yeo_johnson("x", lam).alias("_y"),
                               yeo_johnson("x0", lam).alias("_y0")), [*keys, "_c", "const"]) \
        .withColumn("_v", F.col("_ss") / F.col("_n"))
    ok = (F.col("_v") > F.lit(_VAR_GUARD) * F.col("_mean") * F.col("_mean")) & (F.col("_v") > 0)
    ll = F.when(ok, -0.5 * F.col("_n") * F.log(F.col("_v")) + (lam - 1.0) * F.col("const"))
    ev = ev.select(*keys, "_c", ll.alias("ll")).filter(F.col("ll").isNotNull())
    # deterministic arg-max: highest ll, then smallest λ
    best = ev.groupBy(*keys).agg(F.max(F.struct(F.col("ll"), (-F.col("_c")).alias("neg"))).alias("_b"))
    return best.select(*keys, (-F.col("_b.neg")).alias("_c"), F.col("_b.ll").alias("ll"))


def yeo_johnson_lambdas(df: DataFrame, cols: list[str], group_cols: list[str] | tuple = (),
                        limits=YJ_LIMITS, min_unique: int = YJ_MIN_UNIQUE) -> DataFrame:
    """``group…, metric, lambda, loglik, n, n_distinct`` (λ NULL = untransformed)."""
    keys = [*group_cols, "metric"]
    return _lambdas(*_histogram(df, cols, keys), keys, limits, min_unique)


def _lambdas(hist: DataFrame, stats: DataFrame, keys: list[str], limits=YJ_LIMITS,
             min_unique: int = YJ_MIN_UNIQUE) -> DataFrame:
    lo, hi = int(round(limits[0] * 1000)), int(round(limits[1] * 1000))
    grid = F.array(*[F.lit(v) for v in range(lo, hi + 1, _LEVELS[0])])
    best = _loglik(hist.withColumn("_c", F.explode(grid)), keys)
    for step in _LEVELS[1:]:
        around = F.explode(F.array(*[F.lit(d * step) for d in range(-_HALF, _HALF + 1)]))
        near = best.withColumn("_d", around).select(*keys, (F.col("_c") + F.col("_d")).alias("_c")) \
            .filter(F.col("_c").between(lo, hi))
        best = _loglik(_joined(hist, near, keys), keys)
    lam = F.col("_c") / F.lit(1000.0)
    at_limit = (F.abs(lam - F.lit(float(limits[0]))) <= YJ_EPS) | \
               (F.abs(lam - F.lit(float(limits[1]))) <= YJ_EPS)
    return written(_joined(stats, best, keys, "left").select(
        *keys,
        F.when((F.col("n_distinct") < min_unique) | at_limit | F.col("_c").isNull(),
               F.lit(None).cast("double")).otherwise(lam).alias("lambda"),
        F.col("ll").alias("loglik"), "n", "n_distinct"), "power-lambdas")


def _joined(left: DataFrame, params: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a NULL group being a group like any other."""
    other = params.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                          *[c for c in params.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def fit_power_standardise(df: DataFrame, cols: list[str], group_cols: list[str] | tuple = (),
                          power: bool = True) -> DataFrame:
    """``group…, metric, lambda, mean, sd`` fitted on ``df`` itself: λ first,
    then mean and sample SD of the transformed values (recipe order), from the
    same histogram."""
    keys = [*group_cols, "metric"]
    hist, stats = _histogram(df, cols, keys)
    lam = _lambdas(hist, stats, keys).select(*keys, "lambda") if power else \
        stats.select(*keys, F.lit(None).cast("double").alias("lambda"))
    rows = _joined(hist, lam, keys).select(*keys, "lambda", "w", yeo_johnson("x", F.col("lambda")).alias("_y"),
                                           yeo_johnson("x0", F.col("lambda")).alias("_y0"))
    return written(_moments(rows, [*keys, "lambda"]).select(
        *keys, "lambda", F.col("_mean").alias("mean"),
        F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - 1))).alias("sd")), "power-parameters")


def apply_power_standardise(df: DataFrame, params: DataFrame, cols: list[str],
                            group_cols: list[str] | tuple = ()) -> DataFrame:
    """Replace each metric by ``(yj(x, λ) - mean) / sd``; a zero or undefined
    SD gives 0.0 (Spark ``StandardScaler`` convention).  Other columns pass
    through; one row out per row in."""
    group_cols = list(group_cols)
    out = df
    wide = params.groupBy(*group_cols).agg(*[
        F.first(F.when(F.col("metric") == c, F.struct("lambda", "mean", "sd")),
                ignorenulls=True).alias(f"_p_{c}") for c in cols]) if group_cols else None
    if group_cols:
        out = _joined(out, wide, group_cols, "left")
        for c in cols:
            p = F.col(f"_p_{c}")
            out = out.withColumn(c, standardised(yeo_johnson(F.col(c), p["lambda"]),
                                                 p["mean"], p["sd"]))
        return out.drop(*[f"_p_{c}" for c in cols])
    rows = {r["metric"]: r for r in params.collect()}   # one row per metric
    return out.select(*[
        standardised(yeo_johnson(F.col(c), rows[c]["lambda"]),
                     F.lit(rows[c]["mean"]).cast("double"),
                     F.lit(rows[c]["sd"]).cast("double")).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def standardised(y: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd.isNull() | (sd == 0), F.when(y.isNull(), None).otherwise(F.lit(0.0))) \
        .otherwise((y - mean) / sd)


# --------------------------------------------------------------------- ML API
class _YJParams(HasInputCols, HasOutputCols):
    power = Param(Params._dummy(), "power", "apply the Yeo-Johnson step",
                  typeConverter=TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(power=True)


class YeoJohnsonScaler(Estimator, _YJParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: Yeo-Johnson (optional) + centre + scale of ``inputCols``."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, power=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "YeoJohnsonScalerModel":
        cols = self.getInputCols()
        params = {r["metric"]: r for r in
                  fit_power_standardise(dataset, cols, power=self.getOrDefault("power")).collect()}
        m = YeoJohnsonScalerModel(
            inputCols=cols, outputCols=self.getOutputCols() if self.isSet("outputCols") else cols,
            lambdas=[_nan(params[c]["lambda"]) for c in cols],
            means=[_nan(params[c]["mean"]) for c in cols],
            sds=[_nan(params[c]["sd"]) for c in cols])
        return m


def _nan(v):
    return float("nan") if v is None else float(v)


class YeoJohnsonScalerModel(Model, _YJParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted transform; λ = NaN means "not transformed"."""

    lambdas = Param(Params._dummy(), "lambdas", "λ per column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    sds = Param(Params._dummy(), "sds", "sd per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, power=True, lambdas=None,
                 means=None, sds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        import math
        cols, outs = self.getInputCols(), self.getOutputCols()
        lam, mu, sd = (self.getOrDefault(p) for p in ("lambdas", "means", "sds"))
        exprs = {}
        for c, o, l_, m_, s_ in zip(cols, outs, lam, mu, sd):
            y = yeo_johnson(F.col(c), None if math.isnan(l_) else l_)
            exprs[o] = standardised(y, F.lit(None if math.isnan(m_) else m_).cast("double"),
                                    F.lit(None if math.isnan(s_) else s_).cast("double"))
        keep = [F.col(f"`{c}`") for c in dataset.columns if c not in exprs]
        return dataset.select(*keep, *[e.alias(o) for o, e in exprs.items()])
