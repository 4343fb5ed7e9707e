"""Summary and profile tables (the numbers behind the reference's plots).

Every table here is an aggregate over customer-grain data grouped by a small
label (quartile, tier, cluster, metric), so the result size is bounded by the
number of labels; population figures are derived from the per-group partial
sums (a window over that tiny table), never from a second pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "Customer_Key"
# fixed values: metric display order of the profile plots
METRIC_ORDER = {"RecencyDays": 1, "Frequency": 2, "Monetary": 3, "Tenure": 4, "Streaming": 5,
                "Recency": 1, "logFrequency": 2, "logMonetary": 3}
ROUND = 6
EDGE_EPS = 1e-9


def r6(c):
    return F.round(c, ROUND)


def metric_order(col: str = "metric"):
    expr = None
    for name, pos in METRIC_ORDER.items():
        cond = F.col(col) == name
        expr = F.when(cond, F.lit(pos)) if expr is None else expr.when(cond, F.lit(pos))
    return expr.cast("int")


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Customers per label, smallest first (the bar order of the plot)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy("n", label)


def quartile_stats(scored: DataFrame, value: str = "Monetary", q: str = "M_Quantile") -> DataFrame:
    """Mean and min of ``value`` per quartile (the reference's sanity check)."""
    return scored.groupBy(q).agg(r6(F.avg(F.col(value).cast("double"))).alias("mean_value"),
                                 F.min(F.col(value).cast("double")).alias("min_value"))


def code_sizes(scored: DataFrame) -> DataFrame:
    """Customers per RFMT code, largest first."""
    return scored.groupBy("RFM_Segment").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "RFM_Segment")


def tier_summary(tiers: DataFrame, metrics=("RecencyDays", "Frequency", "Monetary", "Tenure"),
                 na_policy: str = "propagate") -> DataFrame:
    """Mean of each metric per tier (``R_mean`` …)."""
    from custseg.functions.aggregates import na_mean
    names = {"RecencyDays": "R_mean", "Frequency": "F_mean", "Monetary": "M_mean",
             "Tenure": "T_mean", "Streaming": "S_mean"}
    return tiers.groupBy("Customer_Segment", "Segment_Order").agg(
        *[r6(na_mean(m, na_policy)).alias(names[m]) for m in metrics])


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("Customer_Segment", "Segment_Order").agg(F.count(F.lit(1)).alias("n"))


def relative_importance(tiers: DataFrame) -> DataFrame:
    """Group mean / population mean - 1 per tier and metric, long form, with
    the heat-map label ``round(value, 2)``.  Monetary means skip NULLs
    (``na.rm=TRUE`` in the reference), the others do not."""
    metrics = [("Recency", "RecencyDays", "propagate"), ("Frequency", "Frequency", "propagate"),
               ("Monetary", "Monetary", "skip"), ("Tenure", "Tenure", "propagate")]
    aggs = []
    for name, col, pol in metrics:
        x = F.col(col).cast("double")
        aggs += [F.sum(x).alias(f"s_{name}"), F.count(x).alias(f"c_{name}")]
    aggs.append(F.count(F.lit(1)).alias("rows"))
    groups = tiers.groupBy("Customer_Segment", "Segment_Order").agg(*aggs)
    everything = Window.partitionBy()   # over the handful of tier rows only
    ratios = []
    for name, _col, pol in metrics:
        s, c = F.col(f"s_{name}"), F.col(f"c_{name}")
        g_mean = F.when(c > 0, s / c)
        p_mean = F.when(F.sum(c).over(everything) > 0,
                        F.sum(s).over(everything) / F.sum(c).over(everything))
        if pol == "propagate":   # any NULL -> NA mean, in the group and the population
            g_mean = F.when(c < F.col("rows"), None).otherwise(g_mean)
            p_mean = F.when(F.sum(c).over(everything) < F.sum("rows").over(everything),
                            None).otherwise(p_mean)
        # a zero population mean has no ratio (R gives Inf/NaN); ANSI mode
        # would raise on the division, so it becomes NULL
        ratios.append(F.when(p_mean != 0, g_mean / p_mean - 1).alias(f"v_{name}"))
    groups = groups.select("Customer_Segment", "Segment_Order", *ratios)
    cols = [F.struct(F.lit(name).alias("metric"), F.col(f"v_{name}").alias("v"))
            for name, _c, _p in metrics]
    long = groups.select("Customer_Segment", "Segment_Order", F.explode(F.array(*cols)).alias("m"))
    return long.select("Customer_Segment", "Segment_Order", F.col("m.metric").alias("metric"),
                       metric_order("m.metric").alias("metric_order"),
                       r6(F.col("m.v")).alias("value"), F.round(F.col("m.v"), 2).alias("label"))


def feature_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """``map_df(range)``: min and max of every column, long form."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"min_{c}"),
                 F.max(F.col(c).cast("double")).alias(f"max_{c}")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("min_value"),
                 F.col(f"max_{c}").alias("max_value")) for c in cols])).alias("r")).select(
                     "r.*", metric_order("r.column").alias("metric_order"))


def log_features_long(tiers: DataFrame) -> DataFrame:
    """Non-negative Monetary only; log Recency, log Frequency, log(Monetary+1),
    raw Tenure; long form.  Non-finite values (log 0) are dropped, as the
    density plot drops them."""
    base = tiers.filter(F.col("Monetary") >= 0).select(
        KEY, "Customer_Segment",
        F.log(F.col("RecencyDays").cast("double")).alias("RecencyDays"),
        F.log(F.col("Frequency").cast("double")).alias("logFrequency"),
        F.log1p(F.col("Monetary").cast("double")).alias("logMonetary"),
        F.col("Tenure").cast("double").alias("Tenure"))
    long = base.unpivot([KEY, "Customer_Segment"],
                        ["RecencyDays", "logFrequency", "logMonetary", "Tenure"], "name", "value")
    return long.filter(F.col("value").isNotNull()).select(
        KEY, "Customer_Segment", "name", metric_order("name").alias("metric_order"), r6(F.col("value")).alias("value"))


def to_long(df: DataFrame, ids: list[str], metrics: list[str], name: str = "metric",
            value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]) \
        .unpivot(ids, metrics, name, value)


def profile_long(df: DataFrame, group_col: str, metrics: list[str],
                 extra_group: tuple = (), value_range: tuple | None = None) -> DataFrame:
    """Mean of each (normalised) metric per group: snake-plot data.
    Means skip NULLs (``na.rm=TRUE``).  ``value_range`` drops the mean points
    outside the axis limits (``ylim(-2, 2)`` on the profile lines)."""
    ids = [*extra_group, group_col]
    long = to_long(df, ids, metrics)
    out = long.groupBy(*ids, "metric").agg(F.avg("value").alias("value")).select(
        *ids, "metric", metric_order().alias("metric_order"), r6(F.col("value")).alias("value"))
    if value_range is not None:
        out = out.filter(F.col("value").between(*value_range))
    return out


def profile_wide(long: DataFrame, group_col: str, metrics: list[str]) -> DataFrame:
    """``pivot_wider(names_from = metric)`` with the metric list given, so the
    pivot needs no extra pass to discover its values."""
    return long.groupBy(group_col).pivot("metric", metrics).agg(F.first("value"))


def clip(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.filter(F.col(col).between(lo, hi))


def histogram_density(long: DataFrame, group_col: str, name_col: str = "name",
                      value_col: str = "value", bins: int = 30) -> DataFrame:
    """Equal-width histogram density per (name, group); the bin grid spans the
    range of each name over all groups (``facet_wrap(scales="free")``).
    density = count / (group rows of that name × bin width)."""
    rng = long.groupBy(name_col).agg(F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    j = long.join(F.broadcast(rng), name_col)  # one row per name: bounded
    # a value on a bin edge belongs to the upper bin; 1e-9 absorbs last-bit
    # rounding so that every engine puts it in the same bin
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value_col) - F.col("_lo")) / w + F.lit(EDGE_EPS)),
                F.lit(bins - 1))).cast("int")
    counts = j.groupBy(name_col, group_col, "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("_n")).select(name_col, group_col, "_n")
    hist = j.groupBy(name_col, group_col, b.alias("bin"), "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("n"))
    hist = hist.join(counts, [name_col, group_col])
    width = (F.col("_hi") - F.col("_lo")) / bins
    return hist.select(
        name_col, metric_order(name_col).alias("metric_order"), group_col, "bin",
        r6(F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        r6(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        "n",
        r6(F.when(width > 0, F.col("n") / (F.col("_n") * width))).alias("density"))


def bandwidth(n, sd, iqr, low):
    """Rule-of-thumb bandwidth ``0.9 · min(sd, IQR / 1.34) · n^-0.2``; a spread of 0 is
    replaced by the SD, then by the size of the least value, then by 1."""
    spread = F.least(sd, iqr / F.lit(1.34))
    for other in (sd, F.abs(low)):
        spread = F.when(spread > 0, spread).otherwise(other)
    spread = F.when(spread > 0, spread).otherwise(F.lit(1.0))
    return F.lit(0.9) * spread * F.pow(n.cast("double"), F.lit(-0.2))


def kernel_density(long: DataFrame, group_col: str, name_col: str = "name", value_col: str = "value",
                   points: int = 512, tiebreak: str = KEY) -> DataFrame:
    """Gaussian kernel density per (name, group) at ``points`` places over the range of
    the name in all groups, with the group's rule-of-thumb bandwidth.

    Values are binned linearly on the places (a value shares itself between its two
    neighbours), so the rows shrink map-side to at most ``points`` weights a group, and
    the kernel is summed over weights, not rows: points² terms a (name, group)
    whatever the data.  Quartiles for the bandwidth are exact, by distributed rank.
    Groups of fewer than two values have no curve; a name with one value has one place."""
    from custseg.operators.quantiles import exact_quantiles
    long = long.filter(F.col(value_col).isNotNull()).select(
        group_col, name_col, F.col(value_col).alias("_v"), tiebreak)
    rng = long.groupBy(name_col).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(points - 1)
    placed = long.join(F.broadcast(rng), name_col)      # one row per name: bounded
    at = F.when(step > 0, F.least((F.col("_v") - F.col("_lo")) / step, F.lit(float(points - 1)))).otherwise(F.lit(0.0))
    low = F.floor(at)
    share = placed.withColumn("_at", at).withColumn("_b", F.explode(F.array(
        F.struct(low.cast("int").alias("i"), (F.lit(1.0) - (F.col("_at") - low)).alias("w")),
        F.struct((low + 1).cast("int").alias("i"), (F.col("_at") - low).alias("w")))))
    weights = share.filter("_b.w > 0").groupBy(name_col, group_col, F.col("_b.i").alias("_i"), "_lo", "_hi").agg(
        F.sum("_b.w").alias("_w"))
    q = exact_quantiles(long, [group_col, name_col], "_v", tiebreak, [0.25, 0.75])
    spread = long.groupBy(group_col, name_col).agg(F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_min"))
    h = q.join(spread, [group_col, name_col]).filter("n > 1").select(
        group_col, name_col, F.col("n").alias("n"),
        bandwidth(F.col("n"), F.col("_sd"), F.col("q1") - F.col("q0"), F.col("_min")).alias("bandwidth"))
    grid = weights.join(h, [group_col, name_col]).withColumn("point", F.explode(F.when(
        step > 0, F.sequence(F.lit(0), F.lit(points - 1))).otherwise(F.array(F.lit(0)))))
    z = (F.col("point") - F.col("_i")) * step / F.col("bandwidth")
    sums = grid.groupBy(name_col, group_col, "point", "_lo", "_hi", "n", "bandwidth").agg(
        F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_k"))
    root = F.sqrt(F.lit(2.0) * F.pi())
    return sums.select(
        name_col, metric_order(name_col).alias("metric_order"), group_col, "point",
        r6(F.col("_lo") + F.col("point") * step).alias("x"), r6(F.col("bandwidth")).alias("bandwidth"), "n",
        r6(F.col("_k") / (F.col("n") * F.col("bandwidth") * root)).alias("density"))


def box_stats(long: DataFrame, group_col: str, name_col: str = "metric",
              value_col: str = "value", value_range: tuple | None = None,
              tiebreak: str = KEY, accuracy: float | None = None) -> DataFrame:
    """Tukey box statistics per (group, name): quartiles by linear
    interpolation (R type 7), whiskers = most extreme values within 1.5·IQR.
    ``value_range`` first removes values outside the axis limits, as ggplot
    does before computing the boxes.  Quartiles come from a distributed exact
    rank (no group is gathered into one task); whiskers are plain min/max.
    With ``accuracy`` the quartiles come from a mergeable sketch instead
    (``operators.sketch``): no sort of the rows, quartiles within that share."""
    from custseg.operators import sketch
    from custseg.operators.quantiles import exact_quantiles
    if value_range is not None:
        long = long.filter(F.col(value_col).between(*value_range))
    by, probs = [group_col, name_col], [0.25, 0.5, 0.75]
    if accuracy is None:
        q = exact_quantiles(long, by, value_col, tiebreak, probs)
    else:
        q = sketch.quantiles(sketch.sketch(long, by, value_col, accuracy), by, probs, accuracy)
    q = q.select(group_col, name_col, "n", F.col("q0").alias("q1"),
                 F.col("q1").alias("median"), F.col("q2").alias("q3"))
    # one row per (group, name); groups may be segments x clusters, so the size of the
    # broadcast is left to Spark's threshold
    j = long.join(q, [group_col, name_col])
    iqr = F.col("q3") - F.col("q1")
    inside_lo = F.col(value_col) >= F.col("q1") - 1.5 * iqr
    inside_hi = F.col(value_col) <= F.col("q3") + 1.5 * iqr
    w = j.groupBy(group_col, name_col, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside_lo, F.col(value_col))).alias("lower"),
        F.max(F.when(inside_hi, F.col(value_col))).alias("upper"))
    return w.select(group_col, name_col, metric_order(name_col).alias("metric_order"), "n", r6(F.col("q1")).alias("q1"),
                    r6(F.col("median")).alias("median"), r6(F.col("q3")).alias("q3"),
                    r6(F.col("lower")).alias("lower"), r6(F.col("upper")).alias("upper"))


def legacy_normalise(df: DataFrame, metrics: list[str], keep: list[str],
                     drop_na: bool = False) -> DataFrame:
    """The older (commented-out) normalisation: negative Monetary -> NULL,
    log(x+1), subtract the mean and round to 1 decimal (half-even), then
    ``scale()`` (centre + divide by the sample SD, NULLs skipped)."""
    base = df.select(*keep, *[
        F.log1p(F.when(F.col(m) >= 0, F.col(m)).cast("double") if m == "Monetary"
                else F.col(m).cast("double")).alias(m) for m in metrics])
    # two one-row aggregates (p numbers each) reach the driver
    mrow = base.agg(*[F.avg(m).alias(m) for m in metrics]).collect()[0]
    rounded = base.select(*keep, *[F.bround(F.col(m) - F.lit(mrow[m]), 1).alias(m) for m in metrics])
    stats = rounded.agg(*[F.avg(m).alias(f"a_{m}") for m in metrics],
                        *[F.stddev_samp(m).alias(f"s_{m}") for m in metrics]).collect()[0]
    def z(m):
        sd = stats[f"s_{m}"]
        if not sd:             # constant or single value: scale() leaves NaN; here NULL
            return F.lit(None).cast("double")
        return r6((F.col(m) - F.lit(stats[f"a_{m}"])) / F.lit(sd))
    out = rounded.select(*keep, *[z(m).alias(m) for m in metrics])
    return out.dropna(subset=metrics) if drop_na else out
