"""Language identification by string kernels.

Kernel.  ``k(x, z)`` counts the character n-grams (here byte n-grams of the
UTF-8 text, lengths 1 to 5 blended) present in both texts, divided by the
geometric mean of how many each holds: a normalised blended-spectrum presence
kernel.  A text is its set of distinct n-grams, each an exact number (its bytes
and its length), so no text is long enough to fill a table.

Model.  ``LANDMARKS`` training texts span a Nystroem space: with K the kernel of
the landmarks, a text maps to ``k(x, landmarks) K^(-1/2)``.  One-versus-rest
ridge regression in that space gives a weight column per language.  The sample
holds at most ``SAMPLE_PER_LANG`` texts a language (expected; see ``fit``); the
driver gets the n-grams of the landmarks, texts of at most ``LANDMARK_BYTES`` bytes
(longer ones train but are no landmarks, unless there are no others), and a row of
``LANDMARKS`` counts for each other text of the sample.  The languages take turns in
giving landmarks; beyond ``LANDMARKS`` languages the last ones have none of their own.

Scoring.  The distinct n-grams of every whole text of a batch are looked up among
those of the landmarks and counted per landmark; the batch's counts, divided by the
norms, are its kernel matrix (texts x landmarks), and one matrix product with the
solved coefficients (landmarks x languages) scores the batch.  No row leaves its
partition: one scan, no shuffle.

Cases: null text and text without a letter give ``und`` with score 0; text of
any length is used whole; ties go to the first language in code-point order; a
table without training rows predicts ``und`` for all.  Only the id, the text
and, for training, the language are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import CHUNK_BYTES, saved, utf8

LENGTHS = (1, 2, 3, 4, 5)
SAMPLE_PER_LANG = 400
LANDMARKS = 160
LANDMARK_BYTES = 1 << 16
BATCH_GRAMS = 1 << 14           # n-grams counted together in a task
RIDGE = 0.05
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes.sort()
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return codes[new]


def grams(data: np.ndarray) -> np.ndarray:
    """The distinct n-grams of ``data``, ascending: the bytes of each below its length.
    Letters are folded to lower case (ASCII) and every other ASCII byte to a blank."""
    low = _FOLD[data]
    out = np.zeros(0, np.uint64)
    for i in range(0, max(len(low), 1), CHUNK_BYTES):
        part = low[i:i + CHUNK_BYTES + LENGTHS[-1] - 1].astype(np.uint64)
        gram, codes = np.zeros(len(part), np.uint64), []
        for n in LENGTHS:
            if len(part) < n:
                break
            gram = (gram[:len(part) - n + 1] << np.uint64(8)) | part[n - 1:]
            codes.append(gram | np.uint64(n << 40))
        if codes:
            got = _distinct(np.concatenate(codes))
            out = _distinct(np.concatenate([out, got])) if len(out) else got
    return out


_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def places(vocab: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where the n-grams ``own`` stand in ``vocab`` (both ascending), without those that do not."""
    if not len(vocab):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocab, own), len(vocab) - 1)
    return at[vocab[at] == own]


class Landmarks:
    """The distinct n-grams of the landmarks, which landmarks hold each, and their norms."""

    def __init__(self, sets: list[np.ndarray]):
        self.vocab, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.holder = owner[np.argsort(flat, kind="stable")].astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(self.vocab)))])
        self.norm = np.sqrt(np.maximum([len(s) for s in sets], 1))

    def kernel(self, data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Kernel matrix (``rows`` x landmarks) of texts given end to end."""
        shared = np.zeros((len(rows), len(self.norm)))
        size = np.ones(len(rows))
        held, texts, n = [], [], 0
        for i, r in enumerate(rows):
            own = grams(data[off[r]:off[r + 1]])
            size[i] = max(len(own), 1)
            at = places(self.vocab, own)
            for j in range(0, len(at), BATCH_GRAMS):
                held.append(at[j:j + BATCH_GRAMS])
                texts.append(i)
                n += len(held[-1])
                if n >= BATCH_GRAMS:
                    self._count(shared, held, texts)
                    held, texts, n = [], [], 0
        if held:
            self._count(shared, held, texts)
        return shared / self.norm / np.sqrt(size)[:, None]

    def _count(self, shared: np.ndarray, held: list[np.ndarray], texts: list[int]) -> None:
        at = np.concatenate(held)
        low = texts[0]
        many = self.start[at + 1] - self.start[at]
        flat = np.repeat(self.start[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        text = np.repeat(np.repeat(np.array(texts) - low, [len(h) for h in held]), many)
        wide, high = len(self.norm), texts[-1] + 1
        shared[low:high] += np.bincount(text * wide + self.holder[flat], minlength=(high - low) * wide).reshape(-1, wide)


class Model:
    """Languages, landmarks and the coefficients (landmarks x languages)."""

    def __init__(self, langs: list[str], landmarks: Landmarks, weights: np.ndarray):
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def decide(self, data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score in [0, 1] of the texts ``rows``."""
        f = self.landmarks.kernel(data, off, rows) @ self.weights
        e = np.exp(6.0 * (f - f.max(1, keepdims=True)))
        return f.argmax(1), 1.0 / e.sum(1)


def _grams_of(rows: DataFrame) -> DataFrame:
    """``_o, _t, grams``: the n-grams of each text."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            for i in range(len(off) - 1):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1),
                     pa.array([grams(data[off[i]:off[i + 1]]).tobytes()], pa.binary())], names=["_o", "_t", "grams"])
    return rows.select("_o", "_t", "text").mapInArrow(make, "_o long, _t long, grams binary")


def _kernel_of(rows: DataFrame, landmarks: Landmarks) -> DataFrame:
    """``_o, _t, k``: the kernel of each text with every landmark."""
    sent = rows.sparkSession.sparkContext.broadcast(landmarks)     # at most LANDMARKS bounded texts

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            k = sent.value.kernel(data, off, np.arange(len(off) - 1)).astype("<f8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in k], pa.binary())],
                                             names=["_o", "_t", "k"])
    return rows.select("_o", "_t", "text").mapInArrow(make, "_o long, _t long, k binary")


def fit(train: DataFrame, order: Column, per_lang: int = SAMPLE_PER_LANG, landmarks: int = LANDMARKS,
        ridge: float = RIDGE, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Learn from ``train`` (text and language).  ``order`` is a uniform long per
    row: a language keeps the rows under the share that leaves ``per_lang`` of
    them in expectation, so the sample is bounded whatever the table's size."""
    rows = train.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
                        order.alias("_o")).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).collect()   # a row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_lang / r["_n"]))])
    unit = F.pmod(F.col("_o"), F.lit(1 << 40)) / float(1 << 40)
    sample = saved(rows.filter(unit < share[F.col("lang")]).withColumn("_t", F.xxhash64("text")), "langid-sample")
    got = sample.select("lang", "_o", "_t", (F.octet_length("text") > LANDMARK_BYTES).alias("_long")).collect()
    keys = sorted((r["lang"].encode(), r["_o"], r["_t"]) for r in got)
    long = {r["_t"] for r in got if r["_long"]}
    long = long if len(long) < len({r["_t"] for r in got}) else set()
    if not keys:
        return None
    names = sorted({k[0] for k in keys})
    # landmarks: the languages in turn, each in the order of ``order``; a text once
    seen, turn, queue = set(), dict.fromkeys(names, 0), []
    for lang, o, t in keys:
        if t not in seen and t not in long:
            seen.add(t)
            queue.append((turn[lang], lang, o, t))
            turn[lang] += 1
    chosen = [t for _, _, _, t in sorted(queue)[:landmarks]]
    held = {r["_t"]: np.frombuffer(bytes(r["grams"]), np.uint64) for r in
            _grams_of(sample.filter(F.col("_t").isin(chosen)).dropDuplicates(["_t"])).collect()}
    marks = Landmarks([held[t] for t in chosen])
    got = {(r["_o"], r["_t"]): np.frombuffer(bytes(r["k"]), "<f8") for r in _kernel_of(sample, marks).collect()}
    y = np.array([names.index(k[0]) for k in keys])
    k = np.stack([got[o, t] for _, o, t in keys])
    where = {t: i for i, (_, _, t) in enumerate(keys)}
    z = k[[where[t] for t in chosen]]
    values, vectors = np.linalg.eigh((z + z.T) / 2)
    keep = values > values[-1] * 1e-7
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(names))[y][:, None]        # languages weigh alike
    reg = ridge * np.eye(phi.shape[1]) * (weight * phi ** 2).sum() / phi.shape[1]
    w = np.linalg.solve(phi.T @ (weight * phi) + reg, phi.T @ (weight * target))
    return Model([n.decode() for n in names], marks, root @ w)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)     # bounded: LANDMARKS texts of LANDMARK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            data, off = utf8(b.column(1))
            n = len(off) - 1
            pred, score = [UNKNOWN] * n, np.zeros(n)
            rows = np.array([r for r in range(n) if model is not None and _has_letter(data[off[r]:off[r + 1]])], np.int64)
            if len(rows):
                lang, score[rows] = model.decide(data, off, rows)
                for r, c in zip(rows, lang):
                    pred[r] = model.langs[c]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def _has_letter(text: np.ndarray) -> bool:
    if ((text | 32) - 97 < 26).any():
        return True
    return bool(_LETTER.search(text.tobytes().decode("utf-8", "replace")))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept away from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    train = docs.filter(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull())
    model = fit(train, F.xxhash64(F.col(f"`{id_col}`"), F.lit(10)), lang_col=lang_col, text_col=text_col)
    return predict(docs, model, id_col, text_col).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
