"""Quality classifier from weak labels.

Labellers.  Each reads a whole text (or the given annotations) and says ``bad``,
``good`` or nothing; they overlap and err:
repeats (a word follows itself), symbols, capitals, echoes (5-word shingles
that came before), variety (distinct words in windows of ``WINDOW`` words, all of
the text, so that it does not fall with the length), insults (a word or word
start whose labelled contexts are toxic), and annotators (the table of labels,
where it covers the document).

Label model.  A document is clean, junk or toxic.  Expectation-maximisation
estimates, without knowing the class, how often every labeller says what about
each class -- its accuracies -- and the class shares.  It runs on the counts of
the vote patterns: all documents count, and the table it iterates on has at
most 4 * 3**6 rows whatever the corpus.

Scorer.  The posterior classes of the documents are the labels of a linear
model (softmax regression) on hashed words (``DIM`` slots) and the votes that
the text itself gives; annotations are no input of it.  It is fitted on at most
about ``TRAIN_ROWS`` documents and scores all of them in one scan, whole texts,
without a shuffle.  A document stays when the clean class has at least
``KEEP`` of the probability.

Bounded samples: ``INSULT_ROWS`` annotated rows for the insult list,
``TRAIN_ROWS`` documents for the scorer (both in expectation, by hash).

Cases: null, empty and blank texts hold no words and are rejected with
p_clean 0; very long texts are read whole; repeated rows get the same score;
several annotations of a document count as the worst; null ids have none; an
empty table of documents or labels gives an empty result, or a model without
that labeller.  Other columns pass through ``reject`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custseg.llm.common import keyed, runs_of, saved, utf8, word_hashes

CLASSES = ("clean", "junk", "toxic")
TEXT_VOTES = 6
DIM = 1 << 20
INSULT_ROWS = 20_000
TRAIN_ROWS = 12_000
KEEP = 0.5
EPOCHS = 30
PREFIX = 4
WINDOW = 1000

U = np.uint64
_LOW = np.full(256, 32, np.uint8)               # letters in lower case, other ASCII blank
_LOW[128:] = np.arange(128, 256)
_LOW[97:123] = np.arange(97, 123)
_LOW[65:91] = np.arange(97, 123)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|!<>{}[]@^~=+_\\/"]] = True


def folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words without punctuation, and row offsets."""
    return word_hashes(_LOW[data], off)


def starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes of the first ``PREFIX`` bytes of the same words (0 for shorter words)."""
    low = _LOW[data].copy()
    solid = low != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = off[:-1][off[:-1] < len(low)]
    first[edge] = solid[edge]
    at = np.flatnonzero(first)
    h = np.zeros(len(at), U)
    ok = np.ones(len(at), bool)
    end = off[np.searchsorted(off, at, side="right")]
    for i in range(PREFIX):
        p = np.minimum(at + i, len(low) - 1)
        ok &= (at + i < end) & solid[p]
        h = h * U(0x100000001B3) + low[p].astype(U) + U(1)
    h = (h + U(77)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    return np.where(ok, h, U(0))


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def votes(data: np.ndarray, off: np.ndarray, insults: np.ndarray) -> np.ndarray:
    """A row of ``TEXT_VOTES`` votes per text: 0 bad, 1 good, 2 nothing."""
    rows = len(off) - 1
    out = np.full((rows, TEXT_VOTES), 2, np.uint8)
    if not len(data):
        return out
    words, at = folded(data, off)
    n = np.diff(at).astype(float)
    some = np.maximum(n, 1)
    row = np.repeat(np.arange(rows), np.diff(at))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])

    solid = _per_row((data != 32) & (data != 10), off)
    symbols = _per_row(_SYMBOL[data], off) / np.maximum(solid, 1)
    upper = _per_row((data >= 65) & (data <= 90), off)
    lower = _per_row((data >= 97) & (data <= 122), off)
    capitals = upper / np.maximum(upper + lower, 1)

    # distinct words of all consecutive windows, by the words in them
    window = row * (len(words) // WINDOW + 1) + (np.arange(len(words)) - at[row]) // WINDOW
    order = np.lexsort((words, window))
    new = np.ones(len(words), bool)
    ws, rs = words[order], window[order]
    new[1:] = (ws[1:] != ws[:-1]) | (rs[1:] != rs[:-1])
    variety = np.bincount(row[order][new], minlength=rows) / some
    # shingles of five words seen before in the text
    echo = np.zeros(rows)
    if len(words) >= 5:
        with np.errstate(over="ignore"):
            h = words[:-4].copy()
            for i in range(1, 5):
                h = h * U(0x9E3779B97F4A7C15) + words[i:len(words) - 4 + i]
                h ^= h >> U(31)
        inside = row[4:] == row[:-4]
        h, r = h[inside], row[:-4][inside]
        o = np.lexsort((h, r))
        dup = np.zeros(len(h), bool)
        dup[1:] = (h[o][1:] == h[o][:-1]) & (r[o][1:] == r[o][:-1])
        echo = np.bincount(r[o][dup], minlength=rows) / np.maximum(n - 4, 1)

    def say(j, bad, good):
        out[bad & (n >= 5), j] = 0
        out[good & ~bad & (n >= 5), j] = 1
    repeat = _per_row(again, at) / some
    say(0, repeat >= 0.15, repeat <= 0.05)
    say(1, symbols >= 0.08, symbols <= 0.03)
    say(2, capitals >= 0.5, capitals <= 0.25)
    say(3, echo >= 0.3, echo <= 0.1)
    say(4, variety < 0.25, variety > 0.45)
    if len(insults) and len(words):
        hit = np.isin(words, insults) | np.isin(starts(data, off), insults)
        out[_per_row(hit, at) > 0, 5] = 0
    return out


# ------------------------------------------------------------------- annotations
def annotations(labels: DataFrame) -> DataFrame:
    """``_l`` (id) and ``mark``: 0 junk, 1 clean, 2 toxic; the worst of several."""
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_l")).agg(
        F.min("quality").alias("q"), F.max("toxic").alias("x")).select("_l", F.when(F.col("x") == 1, 2).when(
            F.col("q") == 0, 0).when(F.col("q") == 1, 1).alias("mark")).filter("mark is not null")


def learn_insults(docs: DataFrame, marks: DataFrame, rows: int = INSULT_ROWS) -> np.ndarray:
    """Words and word starts that stand in toxic texts only, by distinct contexts.

    A context is the word before; copies of a text give the same context, so a
    copied toxic text does not make its harmless words look toxic."""
    total = marks.count()
    if not total:
        return np.zeros(0, U)
    # a bounded sample (``rows``), hence a broadcast of known size
    sample = marks.filter(F.pmod(F.xxhash64("_l", F.lit(4)), F.lit(1 << 30)) < (1 << 30) * min(1.0, rows / total))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mark = b.column(0).to_numpy()
            data, off = utf8(b.column(1))
            for i, j in runs_of(off):
                part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                words, at = folded(part, o)
                if not len(words):
                    continue
                begin = starts(part, o)
                row = np.repeat(np.arange(j - i), np.diff(at))
                before = np.concatenate([[U(0)], words[:-1]])
                before[at[:-1][np.diff(at) > 0]] = U(0)
                toxic = mark[i:j][row] == 2
                for h in (words, begin):
                    rec = np.unique(np.stack([h, before * U(0x9E3779B97F4A7C15) >> U(40), toxic.astype(U)], 1)[h != 0],
                                    axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rec[:, 0].view(np.int64) if rec.flags.c_contiguous else
                                  np.ascontiguousarray(rec[:, 0]).view(np.int64)),
                         pa.array(rec[:, 1].astype(np.int64)), pa.array(rec[:, 2].astype(np.int64))],
                        names=["h", "before", "toxic"])
    rec = docs.join(F.broadcast(sample), F.col("_d") == F.col("_l")).select("mark", "_text") \
        .mapInArrow(contexts, "h long, before long, toxic long")
    per = rec.distinct().groupBy("h").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    good = per.filter((F.col("bad") >= 4) & (F.col("bad") >= 0.97 * F.col("all")))
    return np.array(sorted(r["h"] for r in good.select("h").collect()), np.int64).view(U)


# ------------------------------------------------------------------- label model
def fit_label_model(patterns: list[tuple[str, int]], rounds: int = 100) -> dict[str, np.ndarray]:
    """Posterior class shares of each vote pattern, by expectation-maximisation.

    Junk comes in kinds that fail different labellers, so it has a state per
    kind (repetition, symbols, capitals) beside clean and toxic; the kinds are
    added up in the end.  The start gives annotated patterns and those with a
    bad vote their obvious state and leaves the rest mostly clean.  A labeller
    that is silent gives no evidence, except that a text without insults says so."""
    if not patterns:
        return {}
    said = np.array([[int(c) for c in p] for p, _ in patterns])
    count = np.array([c for _, c in patterns], float)
    clean, junk, toxic, states = 0, (1, 2, 3), 4, 5
    kind = np.select([said[:, 1] == 0, said[:, 2] == 0, (said[:, [0, 3, 4]] == 0).any(1), said[:, 5] == 0],
                     [2, 3, 1, toxic], clean)
    mark = said[:, 6]
    kind = np.where(mark == 2, toxic, np.where(mark == 1, clean, np.where((mark == 0) & (kind == clean), 1, kind)))
    sure = np.where(mark != 3, 0.96, 0.85)[:, None]
    post = np.where(np.arange(states) == kind[:, None], sure, (1 - sure) / (states - 1))
    for _ in range(rounds):
        weight = post * count[:, None]
        share = (weight.sum(0) + 1) / (weight.sum() + states)
        log = np.tile(np.log(share), (len(said), 1))
        for j in range(said.shape[1]):
            table = np.stack([np.bincount(said[:, j], weight[:, c], minlength=4) for c in range(states)]) + 0.5
            if j != 5:
                table[:, 3 if j == 6 else 2] = 0
            with np.errstate(divide="ignore"):
                term = np.log(table / table.sum(1, keepdims=True))[:, said[:, j]].T
            log += np.where(np.isfinite(term), term, 0.0)
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-6:
            break
    three = np.stack([post[:, clean], post[:, list(junk)].sum(1), post[:, toxic]], 1)
    return {p: three[i] for i, (p, _) in enumerate(patterns)}


# ------------------------------------------------------------------------ scorer
def features(data: np.ndarray, off: np.ndarray, said: np.ndarray) -> list[np.ndarray]:
    """Slots of each text: its distinct words, then its votes."""
    words, at = folded(data, off)
    slot = (words >> U(64 - DIM.bit_length() + 1)).astype(np.int64)
    vote = DIM + np.arange(TEXT_VOTES) * 3 + said
    return [np.concatenate([np.unique(slot[at[i]:at[i + 1]]), vote[i]]) for i in range(len(off) - 1)]


def weigh(slots: np.ndarray) -> np.ndarray:
    n = len(slots) - TEXT_VOTES
    return np.concatenate([np.full(n, 1 / np.sqrt(max(n, 1))), np.ones(TEXT_VOTES)])


def fit_scorer(slots: np.ndarray, at: np.ndarray, target: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Softmax regression (full gradients, diagonal scaling) on soft targets.

    ``slots`` holds the texts' slots end to end, ``at`` their n + 1 offsets.  Sums
    run over the texts as they lie and over one order by slot, so only two narrow
    arrays of that length stay in memory."""
    w = np.zeros((DIM + 3 * TEXT_VOTES, 3), np.float32)
    if not len(slots):
        return w
    n = np.diff(at)
    used, col = np.unique(slots, return_inverse=True)
    col = col.astype(np.int32)
    # a text's words weigh alike; its votes, the last slots, weigh 1
    word = 1 / np.sqrt(np.maximum(n - TEXT_VOTES, 1))
    val = np.repeat(word, n).astype(np.float32)
    val[(at[1:, None] - 1 - np.arange(TEXT_VOTES)).ravel()] = 1
    by_slot = np.argsort(col, kind="stable").astype(np.int32)
    row_of = np.repeat(np.arange(len(n), dtype=np.int32), n)[by_slot]
    val_of = val[by_slot]
    begin = np.concatenate([[0], np.cumsum(np.bincount(col))[:-1]])
    del by_slot
    part = np.zeros((len(used), 3))
    square = np.full((len(used), 3), 1e-6)
    for _ in range(epochs):
        z = np.stack([np.add.reduceat(val * part[col, c], at[:-1]) for c in range(3)], 1)
        e = np.exp(z - z.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True) - target
        grad = np.stack([np.add.reduceat(val_of * d[row_of, c], begin) for c in range(3)], 1)
        grad = grad / len(n) + 1e-6 * part
        square += grad ** 2
        part -= 0.5 * grad / np.sqrt(square)
    w[used] = part
    return w


def _votes_of(docs: DataFrame, insults: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            out = []
            for i, j in runs_of(off):
                v = votes(data[off[i]:off[j]], off[i:j + 1] - off[i], insults) + 48
                out += [r.tobytes().decode() for r in v]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())],
                                             names=["_d", "_t", "said"])
    return docs.mapInArrow(run, "_d long, _t long, said string")


def _slots_of(docs: DataFrame, insults: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            out = []
            for i, j in runs_of(off):
                part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                out += [s.astype(np.int32).tobytes() for s in features(part, o, votes(part, o, insults))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())],
                                             names=["_d", "_t", "slots"])
    return docs.mapInArrow(run, "_d long, _t long, slots binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Insult list and scorer weights."""
    keys = keyed(docs, id_col, text_col)
    marks = saved(annotations(labels), "quality-marks")
    insults = learn_insults(keys, marks)
    said = saved(_votes_of(keys, insults), "quality-votes")
    voted = saved(said.join(marks, F.col("_d") == F.col("_l"), "left").select(
        "_d", "_t", F.concat("said", F.coalesce(F.col("mark"), F.lit(3)).cast("string")).alias("said")),
        "quality-patterns")
    counts = [(r["said"], r["n"]) for r in voted.groupBy("said").agg(F.count(F.lit(1)).alias("n")).collect()]
    model = fit_label_model(sorted(counts))
    total = sum(c for _, c in counts)
    if not total:
        return insults, fit_scorer(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, 3)))
    sampled = F.pmod(F.xxhash64("_d", "_t", F.lit(9)), F.lit(1 << 30)) < (1 << 30) * min(1.0, train_rows / total)
    got = _slots_of(keys.filter(sampled), insults).withColumnsRenamed({"_d": "_sd", "_t": "_st"}).join(
        voted.filter(sampled), (F.col("_sd") == F.col("_d")) & (F.col("_st") == F.col("_t"))) \
        .dropDuplicates(["_d", "_t"]).orderBy("_d", "_t").select("slots", "said").toArrow()
    data, at = utf8(got.column("slots").combine_chunks())
    target = np.array([model[said] for said in got.column("said").to_pylist()]).reshape(-1, 3)
    return insults, fit_scorer(np.frombuffer(data.tobytes(), np.int32), at // 4, target)


def _score(insults: np.ndarray, weights, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            data, off = utf8(b.column("_q_text"))
            p = np.zeros((b.num_rows, 3))
            for i, j in runs_of(off):
                part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                for r, s in enumerate(features(part, o, votes(part, o, insults)), i):
                    if len(s) == TEXT_VOTES:             # no words
                        p[r] = [0, 1, 0]
                        continue
                    z = weigh(s) @ w[s]
                    e = np.exp(z - z.max())
                    p[r] = e / e.sum()
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], *[pa.array(p[:, c]) for c in range(3)]],
                names=[*names, "_q_clean", "_q_junk", "_q_toxic"])
    return run


def score(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Columns ``keep`` as ``_q_0 ...`` and ``_q_clean, _q_junk, _q_toxic``."""
    insults, w = fit(docs, labels, id_col, text_col)
    weights = docs.sparkSession.sparkContext.broadcast(w)      # fixed size: DIM slots of three classes
    names = [f"_q_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
                       F.col(f"`{text_col}`").alias("_q_text"))
    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, names)],
                           *[T.StructField(f"_q_{c}", T.DoubleType()) for c in CLASSES]])
    return rows.mapInArrow(_score(insults, weights, names), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_clean, p_junk, p_toxic, keep of every row."""
    got = score(docs, labels, [id_col], id_col, text_col)
    return got.select(F.col("_q_0").alias("doc_id"), F.col("_q_clean").alias("p_clean"),
                      F.col("_q_junk").alias("p_junk"), F.col("_q_toxic").alias("p_toxic"),
                      (F.col("_q_clean") >= KEEP).alias("keep"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    got = score(docs, labels, docs.columns, id_col, text_col).filter(F.col("_q_clean") >= KEEP)
    return got.select(*[F.col(f"_q_{i}").alias(c) for i, c in enumerate(docs.columns)])
