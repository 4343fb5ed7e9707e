"""k-means for many models at once, with the same centres on any cluster.

A *problem* is a group (a segment, a cohort, or all rows) and, for
cross-validation, a fold that is held out; for every problem the models of all
wanted k are fitted together.  One pass over the rows advances all models of all
problems, so the number of jobs depends on k and the iteration limit, not on the
number of segments, folds or models.

Method: farthest-point start, then Lloyd steps.  The first centre is the row
nearest to the mean, each further one the row farthest from the centres so far
(ties: the least row, coordinate by coordinate); the start of k centres is the
beginning of the start of k + 1.  A cluster that loses its rows keeps its centre; a
problem with fewer than k distinct rows has fewer centres.

Reproducible: the features are whole multiples of 10^-6 (``SCALE``), so counts
and sums are exact integers, nearest and farthest rows are least elements, and
distances are added column by column.  Neither the partitioning nor the order of
rows, adaptive execution or a lost executor can change a centre, and the same
steps in SQL give the same ones.

Rows travel as blocks (``BLOCK_ROWS`` rows of one group, a small integer matrix),
written once; a pass reads them, and each task returns the sums of its groups.
Groups are split over blocks, so one that holds a third of all rows is no
bottleneck.  The centres of all problems go to the tasks with the job while they
fit into ``STATE_BYTES``; beyond that they stay a table, written by every step
and joined to the blocks by group -- the same functions run on both ways.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custseg.session import written

SCALE = 1_000_000           # features in whole millionths
SSE_SCALE = 1_000_000_000   # a row's squared distance in whole billionths
BLOCK_ROWS = 4096
STATE_BYTES = 8 << 20
_MISSING = -(1 << 63)

_BLOCKS = "_g string, x binary, fold binary"
_PARTS = "_g string, f int, k int, j int, n long, d double, s array<bigint>"
_PART_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64())]


def whole(c: str | Column) -> Column:
    """The feature in millionths (double); NULL, NaN and infinite are NULL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), F.round(x * F.lit(float(SCALE))))


def group_key(group_cols: list[str] | tuple) -> Column:
    """One string for the group; a NULL group is a group like any other."""
    if not group_cols:
        return F.lit("")
    return F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"})


# ----------------------------------------------------------------------- numpy
def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, added column by column; absent centres (NaN) are infinitely far."""
    d = None
    for j in range(x.shape[1]):
        t = x[:, j, None] - centres[None, :, j]
        d = t * t if d is None else d + t * t
    return np.where(np.isnan(d), np.inf, d)


def _least(key: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The least key and, among its rows, the least row."""
    at = np.flatnonzero(key == key.min())
    rows = x[at]
    return float(key[at[0]]), rows[np.lexsort(rows.T[::-1])[0]]


class Phase:
    """What a pass does: ``first`` and ``far`` choose a row, ``sum`` adds up the
    clusters of every k, ``score`` the squared distances."""

    def __init__(self, kind: str, p: int, ks: list[int] = ()):
        self.kind, self.p, self.ks = kind, p, list(ks)

    def parts(self, state: dict, x: np.ndarray, fold: np.ndarray) -> list[tuple]:
        """``f, k, j, n, d, s`` of a block for every problem of its group."""
        out = []
        for f, blob in state.items():
            fill, centres = blob[:self.p], blob[self.p:].reshape(-1, self.p)
            mine = fold == f if self.kind == "score" and f >= 0 else fold != f
            rows = x[mine] if f >= 0 else x
            if not len(rows):
                continue
            rows = np.where(rows == _MISSING, fill, rows.astype(float))
            if self.kind in ("first", "far"):
                d = distances(rows, centres if self.kind == "far" else fill[None, :]).min(1)
                key, row = _least(-d if self.kind == "far" else d, rows)
                out.append((f, 0, 0, 1, key, row.astype(np.int64)))
                continue
            d_all, s = distances(rows, centres), 0
            for k in self.ks:
                d = d_all[:, s:s + k]
                s += k
                if self.kind == "score":
                    units = np.rint(d.min(1) * (SSE_SCALE / SCALE ** 2)).astype(np.int64)
                    out.append((f, k, 0, int(units.sum()), 0.0, np.zeros(0, np.int64)))
                    continue
                label = d.argmin(1)
                n = np.bincount(label, minlength=k)
                sums = np.stack([np.bincount(label, rows[:, j], minlength=k) for j in range(self.p)], 1)
                out += [(f, k, j, int(n[j]), 0.0, sums[j].astype(np.int64)) for j in range(k) if n[j]]
        return out

    def advance(self, blob: np.ndarray, rows: list) -> np.ndarray:
        """The next state of a problem from its reduced rows (k, j, n, d, s)."""
        if self.kind in ("first", "far"):
            row = np.full(self.p, np.nan)
            for _, _, _, d, s in rows:
                if self.kind == "first" or d < 0:
                    row = np.array(s, float)
            return np.concatenate([blob, row])
        new = blob.copy()
        centres = new[self.p:].reshape(-1, self.p)
        begin = dict(zip(self.ks, np.concatenate([[0], np.cumsum(self.ks)[:-1]])))
        for k, j, n, _, s in rows:
            centres[begin[k] + j] = [v / n for v in s]
        return new

    def models(self, blob: np.ndarray) -> np.ndarray:
        """From the start sequence to the centres of every k."""
        fill, seq = blob[:self.p], blob[self.p:].reshape(-1, self.p)
        return np.concatenate([fill, *[seq[:k].ravel() for k in self.ks]])


def _merge(held: dict, found: list[tuple]) -> None:
    for f, k, j, n, d, s in found:
        old = held.get((f, k, j))
        if old is None:
            held[f, k, j] = (n, d, s)
        elif k == 0:
            if (d, s.tolist()) < (old[1], old[2].tolist()):
                held[f, k, j] = (n, d, s)
        else:
            held[f, k, j] = (old[0] + n, d, old[2] + s)


def _passes(phase: Phase, states: dict | None):
    """Blocks to sums; without ``states`` they come with the block (column ``state``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def flush():
            rows = [(group, f, k, j, n, d, s) for (f, k, j), (n, d, s) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PART_TYPES)],
                                              names=[c.split()[0] for c in _PARTS.split(", ")])
        for b in batches:
            for i in range(b.num_rows):
                g = b.column("_g")[i].as_py()
                if g != group:
                    if held:
                        yield flush()
                    group, held = g, {}
                state = states[g] if states is not None else pickle.loads(b.column("state")[i].as_py())
                x = np.frombuffer(b.column("x")[i].as_py(), np.int64).reshape(-1, phase.p)
                fold = np.frombuffer(b.column("fold")[i].as_py(), np.int32)
                _merge(held, phase.parts(state, x, fold))
        if held:
            yield flush()
    return run


def _packed(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = np.array(b.column(0).to_pylist(), object)
            fold = b.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            x = np.stack([b.column(2 + j).fill_null(_MISSING).to_numpy(zero_copy_only=False) for j in range(p)], 1)
            edge = np.flatnonzero(g[1:] != g[:-1]) + 1
            names, xs, folds = [], [], []
            for s, e in zip([0, *edge], [*edge, len(g)]):
                for at in range(s, e, BLOCK_ROWS):
                    end = min(at + BLOCK_ROWS, e)
                    names.append(g[at])
                    xs.append(np.ascontiguousarray(x[at:end]).tobytes())
                    folds.append(fold[at:end].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(xs, pa.binary()),
                                              pa.array(folds, pa.binary())], names=["_g", "x", "fold"])
    return run


# ----------------------------------------------------------------------- Spark
class _Fit:
    def __init__(self, df: DataFrame, cols: list[str], group_cols, fold: Column | None, folds: int,
                 state_bytes: int = STATE_BYTES):
        self.p, self.spark = len(cols), df.sparkSession
        rows = df.select(group_key(group_cols).alias("_g"),
                         (fold if fold is not None else F.lit(0)).cast("int").alias("_f"),
                         *[whole(c).cast("long").alias(f"x{i}") for i, c in enumerate(cols)])
        if group_cols:
            spread = [f"x{i}" for i in range(self.p)]
            rows = rows.repartitionByRange("_g", *spread).sortWithinPartitions("_g")
        self.rows = written(rows, "kmeans-rows")
        self.blocks = written(self.rows.mapInArrow(_packed(self.p), _BLOCKS), "kmeans-blocks")
        per_fold = self.rows.groupBy("_g", "_f").agg(
            F.count(F.lit(1)).alias("n"), *[F.count(f"x{i}").alias(f"c{i}") for i in range(self.p)],
            *[F.sum(f"x{i}").alias(f"s{i}") for i in range(self.p)])
        problems = F.array(*[F.lit(f) for f in range(folds)]) if folds else F.array(F.lit(-1))
        stats = per_fold.select("*", F.explode(problems).alias("f")).filter("f != _f or f = -1") \
            .groupBy("_g", "f").agg(F.sum("n").alias("n"), F.array(*[
                F.coalesce(F.round(F.sum(f"s{i}") / F.sum(f"c{i}")), F.lit(0.0)).cast("double")
                for i in range(self.p)]).alias("fill"))
        self.stats = written(stats, "kmeans-problems")
        self.small = None
        self.limit = state_bytes

    def start(self, k_max: int, per_state: int) -> None:
        """The states: problem -> numbers, on the driver while they are small."""
        if self.stats.count() * per_state * 8 <= self.limit:
            self.small = {}
            for r in self.stats.collect():
                self.small.setdefault(r["_g"], {})[r["f"]] = np.array(r["fill"], float)
            return

        def init(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [b.column("_g"), b.column("f"),
                     pa.array([np.array(v, float).tobytes() for v in b.column("fill").to_pylist()], pa.binary()),
                     pa.array([True] * b.num_rows)], names=["_g", "f", "blob", "moved"])
        self.table = written(self.stats.mapInArrow(init, "_g string, f int, blob binary, moved boolean"), "kmeans-state")

    def reduced(self, phase: Phase) -> DataFrame:
        """``_g, f, k, j, n, d, s`` of all rows."""
        if self.small is not None:
            found = self.blocks.mapInArrow(_passes(phase, self.small), _PARTS)
        else:
            def bundle(batches):
                for b in batches:
                    states = [pickle.dumps({r["f"]: np.frombuffer(r["blob"], float) for r in rows})
                              for rows in b.column("rows").to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column("_g"), pa.array(states, pa.binary())],
                                                     names=["_g", "state"])
            states = written(self.table.groupBy("_g").agg(F.collect_list(F.struct("f", "blob")).alias("rows"))
                             .mapInArrow(bundle, "_g string, state binary"), "kmeans-states")
            found = self.blocks.join(states, "_g").mapInArrow(_passes(phase, None), _PARTS)
        if phase.kind in ("first", "far"):
            return found.groupBy("_g", "f").agg(F.min(F.struct("d", "s")).alias("m")).select(
                "_g", "f", F.lit(0).alias("k"), F.lit(0).alias("j"), F.lit(1).cast("long").alias("n"), "m.d", "m.s")
        width = 0 if phase.kind == "score" else self.p
        return found.groupBy("_g", "f", "k", "j").agg(
            F.sum("n").alias("n"), F.lit(0.0).alias("d"),
            F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).cast("array<bigint>").alias("s"))

    def step(self, phase: Phase) -> bool:
        """Advances every problem; whether anything moved."""
        got = self.reduced(phase)
        if self.small is not None:
            rows: dict = {}
            for r in got.collect():
                rows.setdefault((r["_g"], r["f"]), []).append((r["k"], r["j"], r["n"], r["d"], r["s"]))
            moved = False
            for g, problems in self.small.items():
                for f, blob in problems.items():
                    new = phase.advance(blob, rows.get((g, f), []))
                    moved |= not np.array_equal(new, blob, equal_nan=True)
                    problems[f] = new
            return moved
        rows = got.groupBy(F.col("_g").alias("_g2"), F.col("f").alias("_f2")).agg(
            F.collect_list(F.struct("k", "j", "n", "d", "s")).alias("rows"))

        def advance(batches):
            for b in batches:
                blobs, moved = [], []
                for blob, found in zip(b.column("blob").to_pylist(), b.column("rows").to_pylist()):
                    old = np.frombuffer(blob, float)
                    new = phase.advance(old, [tuple(r.values()) for r in found or []])
                    blobs.append(new.tobytes())
                    moved.append(not np.array_equal(new, old, equal_nan=True))
                yield pa.RecordBatch.from_arrays([b.column("_g"), b.column("f"), pa.array(blobs, pa.binary()),
                                                  pa.array(moved)], names=["_g", "f", "blob", "moved"])
        joined = self.table.join(rows, (F.col("_g") == F.col("_g2")) & (F.col("f") == F.col("_f2")), "left")
        self.table = written(joined.select("_g", "f", "blob", "rows").mapInArrow(
            advance, "_g string, f int, blob binary, moved boolean"), "kmeans-state")
        return bool(self.table.filter("moved").head(1))

    def spread(self, phase: Phase) -> None:
        """Start sequences to models."""
        if self.small is not None:
            for problems in self.small.values():
                for f, blob in problems.items():
                    problems[f] = phase.models(blob)
            return

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [b.column("_g"), b.column("f"), pa.array(
                        [phase.models(np.frombuffer(v, float)).tobytes() for v in b.column("blob").to_pylist()],
                        pa.binary()), b.column("moved")], names=["_g", "f", "blob", "moved"])
        self.table = written(self.table.mapInArrow(run, self.table.schema), "kmeans-state")

    def result(self, phase: Phase) -> DataFrame:
        """``_g, f, k, centres, fill`` of every model."""
        p, ks = phase.p, phase.ks

        def models(g, f, blob):
            fill, centres, s = blob[:p].tolist(), blob[p:].reshape(-1, p), 0
            for k in ks:
                c = centres[s:s + k]
                s += k
                yield g, int(f), k, c[~np.isnan(c[:, 0])].tolist(), fill
        schema = "_g string, f int, k int, centres array<array<double>>, fill array<double>"
        if self.small is not None:
            rows = [m for g, problems in self.small.items() for f, blob in problems.items() for m in models(g, f, blob)]
            return self.spark.createDataFrame(rows, schema)

        def run(batches):
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64())]
            for b in batches:
                for g, f, blob in zip(*(b.column(c).to_pylist() for c in ("_g", "f", "blob"))):
                    rows = list(models(g, f, np.frombuffer(blob, float)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     names=["_g", "f", "k", "centres", "fill"])
        return self.table.select("_g", "f", "blob").mapInArrow(run, schema)


def fit(df: DataFrame, cols: list[str], ks: list[int], max_iter: int, group_cols: list[str] | tuple = (),
        fold: Column | None = None, folds: int = 0, state_bytes: int = STATE_BYTES) -> DataFrame:
    """All models: ``_g, f, k, n, sse, centres, fill`` (centres and fill in millionths).

    ``f`` is -1, or with ``fold`` (a column in 0..folds-1) the fold held out; ``n``
    counts the rows fitted on and ``sse`` is over them, with a fold over the rows held
    out.  A missing feature takes the mean of the rows fitted on."""
    run = _Fit(df, cols, group_cols, fold, folds, state_bytes)
    p, ks = len(cols), sorted(ks)
    run.start(max(ks), p * (1 + sum(ks)))
    run.step(Phase("first", p))
    for _ in range(max(ks) - 1):
        run.step(Phase("far", p))
    run.spread(Phase("sum", p, ks))
    for _ in range(max_iter):
        if not run.step(Phase("sum", p, ks)):
            break
    phase = Phase("score", p, ks)
    sse = run.reduced(phase).select("_g", "f", "k", (F.col("n") / F.lit(float(SSE_SCALE))).alias("sse"))
    return written(run.result(phase).join(run.stats.select("_g", "f", "n"), ["_g", "f"])
                   .join(sse, ["_g", "f", "k"], "left").select(
                       "_g", "f", "k", "n", F.coalesce("sse", F.lit(0.0)).alias("sse"), "centres", "fill"),
                   "kmeans-models")


def growing_k(models: DataFrame, p: int) -> DataFrame:
    """Per problem the largest k reached while each step's relative drop of the sse stays
    at or above ``min(0.02 + 10/n + 2.5/p², 0.8)``; k rows a problem, one remains."""
    w = Window.partitionBy("_g", "f").orderBy("k")
    prev = F.lag("sse").over(w)
    cutoff = F.least(F.lit(0.02) + F.lit(10.0) / F.col("n") + F.lit(2.5 / (p * p)), F.lit(0.8))
    grows = (F.col("k") == 1) | (F.coalesce((prev - F.col("sse")) / F.nullif(prev, F.lit(0.0)), F.lit(0.0)) >= cutoff)
    kept = models.withColumn("_grows", F.min(grows.cast("int")).over(w)).filter("_grows = 1")
    return kept.groupBy("_g", "f").agg(F.max_by(F.struct(*[c for c in models.columns if c not in ("_g", "f")]), "k")
                                       .alias("m")).select("_g", "f", "m.*")


def ranked(centres: Column, signs: list[float]) -> Column:
    """Centres by falling sum of signed features, as ids 1, 2, …; equal ones keep their order."""
    scored = F.transform(centres, lambda c, i: F.struct(
        (-sum((c[j] * F.lit(s) for j, s in enumerate(signs)), F.lit(0.0))).alias("s"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(scored), lambda r: r["c"])


def nearest(cols: list[str], centres: Column, fill: Column, k_max: int) -> Column:
    """1-based id of the nearest of ``centres`` (array of at most ``k_max``); ties: the least id."""
    x = [F.coalesce(whole(c), fill[j]) for j, c in enumerate(cols)]
    options = []
    for i in range(k_max):
        c = F.get(centres, F.lit(i))
        d = None
        for j in range(len(cols)):
            t = x[j] - c[j]
            d = t * t if d is None else d + t * t
        options.append(F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(i + 1).alias("id"))))
    return F.array_min(F.array(*options))["id"]


def label(df: DataFrame, cols: list[str], models: DataFrame, k_max: int, keep: list[str],
          group_cols: list[str] | tuple = ()) -> DataFrame:
    """``keep`` and ``Cluster``: each row by the model (one a group) of its group."""
    if not group_cols:
        m = models.collect()[0]                  # one model: k_max x p numbers
        centres = F.array(*[F.array(*[F.lit(v) for v in c]) for c in m["centres"]])
        fill = F.array(*[F.lit(v) for v in m["fill"]])
        return df.select(*keep, nearest(cols, centres, fill, len(m["centres"])).cast("int").alias("Cluster"))
    named = models.select(F.col("_g"), F.col("centres").alias("_centres"), F.col("fill").alias("_fill"))
    return df.withColumn("_g", group_key(group_cols)).join(named, "_g").select(
        *keep, nearest(cols, F.col("_centres"), F.col("_fill"), k_max).cast("int").alias("Cluster"))
