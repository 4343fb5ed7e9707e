"""Toxicity by averaged subword embeddings and a linear softmax.

Words.  Texts are lower-cased; a word is a run of letters and digits.  A word's
bag holds its character n-grams of 3 to 6 bytes, with the word's ends marked,
and the whole word, hashed into ``BUCKETS`` slots.  Every slot has a vector of
``DIM`` numbers, so a misspelt or inflected word that was never seen shares most
of its vectors with the words it resembles.

Model.  The vectors of a word's bag are averaged, then those of ``WINDOW``
consecutive words (a shorter last window is filled with zeros), and a linear
softmax of two classes reads the average.  A document is as toxic as its most
toxic window, so a few words count alike in a text of ten and of ten thousand.

Training.  Vectors and softmax weights are trained together, in numpy, by full
gradients with Adam steps on the labels of whole documents.  The windows of
a document are pooled by a log-mean-exp whose sharpness grows from near the mean
to near the maximum: the first steps learn from all words, the last ones from the
windows that decide.  Only ``TRAIN_ROWS`` labelled rows are used (in
expectation, by hash of the id, half of them toxic where there are enough), and
no text over ``TRAIN_BYTES`` bytes; these two bounds hold for training alone.

Scoring.  The softmax is linear, so a slot's vector counts by one number only:
the model that travels to the executors is a table of ``BUCKETS`` numbers.  All
documents, whole texts, are scored in one scan without a shuffle.

Cases: null and empty texts and texts without a word score 0.0; very long texts
are read whole; repeated rows score alike; several labels of a document count as
the worst, a null label or id is none; without toxic or without clean labels,
every score is 0.0; an empty table gives no row.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import mix64, runs_of, utf8, word_hashes

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 4
TRAIN_ROWS = 3_000
TRAIN_BYTES = 1 << 13
MIN_ROWS = 3
EPOCHS = 60
THRESHOLD = 0.7
SEED = 13

U = np.uint64
_BASE = U(0x100000001B3)
_WORD = np.full(256, 32, np.uint8)               # everything but letters and digits is blank
_WORD[128:] = np.arange(128, 256)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[48:58] = np.arange(48, 58)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word bytes of all texts end to end (other bytes blank) and row offsets."""
    data, off = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    return _WORD[data], off


def bags(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts and their slots.

    ``word`` (index of the distinct word) of every word and the row offsets of
    the words; ``owner, slot`` of every member of a distinct word's bag."""
    h, at = word_hashes(data, off)
    if not len(h):
        return np.zeros(0, np.int64), at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
    solid = data != 32
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = off[:-1][off[:-1] < len(data)]
    begin[edge] = solid[edge]
    edge = off[1:][off[1:] > 0] - 1
    end[edge] = solid[edge]
    s, e = np.flatnonzero(begin)[first], np.flatnonzero(end)[first] + 1
    size = e - s + 2                             # with both marks
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(s)), size)
    place = np.arange(start[-1]) - start[owner]
    text = data[np.clip(s[owner] + place - 1, 0, len(data) - 1)].astype(U)
    text[start[:-1]] = ord("<")
    text[start[1:] - 1] = ord(">")
    owners, slots = [np.arange(len(s))], [distinct]
    shift = U(64 - BUCKETS.bit_length() + 1)
    with np.errstate(over="ignore"):
        value = text.copy()
        for n in range(2, max(GRAMS) + 1):
            if len(text) < n:
                break
            value = value[:-1] * _BASE + text[n - 1:]
            if n in GRAMS:
                whole = owner[:len(value)] == owner[n - 1:]
                owners.append(owner[:len(value)][whole])
                slots.append(mix64(value[whole] + U(n)))
    return word, at, np.concatenate(owners), (np.concatenate(slots) >> shift).astype(np.int64)


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window of every word, and the window offsets of the rows."""
    n = np.diff(at)
    count = -(-n // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), n)
    return first[row] + (np.arange(at[-1]) - at[row]) // WINDOW, first


def margins(table: np.ndarray, bias: float, word, owner, slot, window, n_windows: int) -> np.ndarray:
    """Logit difference toxic - clean of every window."""
    members = np.bincount(owner)
    of_word = np.bincount(owner, table[slot], minlength=len(members)) / members
    return np.bincount(window, of_word[word], minlength=n_windows) / WINDOW + bias


def _in_rows(word: np.ndarray, at: np.ndarray, owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """At least in how many rows a slot occurs: those of its most common word, or
    its number of words."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows = np.bincount(np.unique(word * len(at) + row) // len(at))
    most = np.zeros(BUCKETS, np.int64)
    np.maximum.at(most, slot, rows[owner])
    return np.maximum(most, np.bincount(slot, minlength=BUCKETS))


class Softmax:
    """Slot vectors and the weights of two classes, trained together."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.weights = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def table(self) -> tuple[np.ndarray, float]:
        """What a slot and the bias add to the logit difference."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])

    def fit(self, texts: pa.Array, toxic: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1) -> Softmax:
        data, off = lowered(texts)
        word, at, owner, slot = bags(data, off)
        window, first = windows(at)
        some = np.flatnonzero(np.diff(first) > 0)                  # rows with a word
        if not len(some) or toxic[some].min() == toxic[some].max():
            self.vectors[:] = 0
            self.bias[:] = [100, -100]
            return self
        y = toxic[some].astype(float)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        begin, sizes = first[:-1][some], np.diff(first)[some]
        row = np.repeat(np.arange(len(some)), sizes)
        members = np.bincount(owner).astype(np.float32)
        often = _in_rows(word, at, owner, slot) >= MIN_ROWS
        owner, slot = owner[often[slot]].astype(np.int32), slot[often[slot]]
        used, at_used = np.unique(slot, return_inverse=True)
        at_used, share = at_used.astype(np.int32), 1 / members[owner]
        e = self.vectors[used].astype(float)
        w, b = self.weights.astype(float), self.bias.astype(float)
        speed = [np.zeros_like(p) for p in (e, w, b)]
        for epoch in range(epochs):
            sharp = 1.0 + 9.0 * min(1.0, epoch / (0.6 * epochs))
            u = w[:, 1] - w[:, 0]
            of_word = np.bincount(owner, (e @ u)[at_used] * share, minlength=len(members))
            m = np.bincount(window, of_word[word], minlength=first[-1]) / WINDOW + (b[1] - b[0])
            top = np.maximum.reduceat(m, begin)
            x = np.exp(sharp * (m - top[row]))
            total = np.add.reduceat(x, begin)
            pooled = top + np.log(total / sizes ** (1.0 / sharp)) / sharp
            p = 1 / (1 + np.exp(-pooled))
            g = ((p - y) * weight)[row] * x / total[row]           # by window
            by_word = np.bincount(word, g[window] / WINDOW, minlength=len(members))
            by_slot = np.bincount(at_used, by_word[owner] * share, minlength=len(used))
            du = e.T @ by_slot
            db = g.sum()
            grads = (np.outer(by_slot, u), np.stack([-du, du], 1), np.array([-db, db]))
            # one step length for a whole matrix: a slot seen in few rows moves little
            for param, grad, v, step in zip((e, w, b), grads, speed, (rate * 2, rate, rate)):
                v += 0.2 * (grad / max(np.abs(grad).max(), 1e-12) - v)
                param -= step * v + 1e-4 * param
        self.vectors[:] = 0                                        # slots never seen say nothing
        self.vectors[used] = e
        self.weights[:], self.bias[:] = w, b
        return self


# ------------------------------------------------------------------------- Spark
def marks(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``_l`` (id) and ``mark`` (1 toxic, 0 clean), the worst of several labels."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("_l"), F.col(f"`{label_col}`").cast("int").alias("m"))
    return known.filter("_l is not null and m is not null").groupBy("_l").agg(
        (F.max("m") > 0).cast("int").alias("mark"))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = TRAIN_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Array, np.ndarray]:
    """Texts and marks of the bounded sample; ``learn`` (a condition on ``_l``,
    the id) says which labels may be used."""
    known = marks(labels, id_col).filter(learn if learn is not None else F.lit(True))
    counts = {r["mark"]: r["n"] for r in known.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = min(counts.get(1, 0), rows // 2)
    part = {1: toxic / max(counts.get(1, 0), 1), 0: min(1.0, (rows - toxic) / max(counts.get(0, 0), 1))}
    drawn = F.pmod(F.xxhash64("_l", F.lit(SEED)), F.lit(1 << 30)) < F.when(
        F.col("mark") == 1, F.lit(int(part[1] * (1 << 30)))).otherwise(F.lit(int(part[0] * (1 << 30))))
    # about ``rows`` rows of two numbers: a broadcast of known size; one text for each id
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_l"), F.col(f"`{text_col}`").alias("text")) \
        .filter(F.octet_length("text").between(1, TRAIN_BYTES)) \
        .join(F.broadcast(known.filter(drawn)), "_l").groupBy("_l", "mark").agg(F.min("text").alias("text"))
    got = texts.orderBy("_l").toArrow()
    return got.column("text").combine_chunks(), got.column("mark").to_numpy()


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = TRAIN_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> Softmax | None:
    """The fitted model, or None without toxic or without clean rows."""
    texts, toxic = training_rows(docs, labels, learn, rows, id_col, text_col)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    return Softmax().fit(texts, toxic)


def probabilities(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of the toxic class of every text, by its most toxic window."""
    out = np.zeros(len(texts))
    data, off = lowered(texts)
    for i, j in runs_of(off):
        word, at, owner, slot = bags(data[off[i]:off[j]], off[i:j + 1] - off[i])
        window, first = windows(at)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            m = margins(table, bias, word, owner, slot, window, first[-1])
            out[i + some] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(m, first[:-1][some]), -500, 500)))
    return out


def classify(docs: DataFrame, model: Softmax | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    # BUCKETS numbers, whatever the corpus
    table, bias = model.table() if model else (None, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros(b.num_rows) if table is None else probabilities(b.column(1), table, bias)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
