"""Toxicity: scores recomputed by hand, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from custseg.llm import queries, toxicity
from tests.conftest import SF01


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, _l int")


def corpus(seed, n=400):
    """Clean texts, and toxic ones that hold inflected insults."""
    rng = np.random.default_rng(seed)
    parts = ["ba", "ne", "lo", "ti", "ra", "mu", "se", "ko"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(5, 300)))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words[int(rng.integers(len(words)))] = rng.choice(["grumpf", "zwixel"]) + word()
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(1)
    return toxicity.Softmax().fit(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def test_unseen_inflections_share_vectors(model):
    rows = corpus(2)
    table, bias = model.table()
    p = toxicity.probabilities(pa.array([r[1] for r in rows]), table, bias)
    y = np.array([r[2] for r in rows])
    assert (p[y == 1] >= toxicity.THRESHOLD).mean() > 0.95 and (p[y == 0] >= toxicity.THRESHOLD).mean() < 0.03


def by_hand(model, text):
    """Softmax of the averaged subword vectors of each window, the most toxic one."""
    shift, best = np.uint64(64 - 18), 0.0
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    from custseg.llm.common import mix64, word_hashes
    for i in range(0, len(words), toxicity.WINDOW):
        total = np.zeros(toxicity.DIM)
        for w in words[i:i + toxicity.WINDOW]:
            raw = w.encode()
            h, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            slots = [int(h[0] >> shift)]
            marked = b"<" + raw + b">"
            for n in toxicity.GRAMS:
                for j in range(len(marked) - n + 1):
                    v = 0
                    for c in marked[j:j + n]:
                        v = (v * 0x100000001B3 + c) % (1 << 64)
                    slots.append(int(mix64(np.array([(v + n) % (1 << 64)], np.uint64))[0] >> shift))
            total += model.vectors[slots].mean(0)
        z = total / toxicity.WINDOW @ model.weights + model.bias
        e = np.exp(z - z.max())
        best = max(best, e[1] / e.sum())
    return best


def test_scores_equal_the_softmax(model):
    texts = [r[1] for r in corpus(3, 12)] + ["", "one", "GRUMPFba!", "É été, grumpflo 12 a b", "..."]
    table, bias = model.table()
    got = toxicity.probabilities(pa.array([*texts, None]), table, bias)
    assert np.allclose(got, [*[by_hand(model, t) for t in texts], 0.0], atol=1e-4)


def test_a_few_words_count_in_a_long_text(model):
    table, bias = model.table()
    clean = " ".join(r[1] for r in corpus(5, 400) if not r[2])
    p = toxicity.probabilities(pa.array([clean, clean + " grumpfne zwixelba " + clean]), table, bias)
    assert p[1] >= toxicity.THRESHOLD and p[1] > p[0]


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "?!"), (5, "x " * 600_000), (6, "grumpfba grumpfne"), (6, "grumpfba grumpfne"),
            (None, "ba ne")]
    got = toxicity.classify(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 4))
    same = [r["score"] for r in got if r["doc_id"] == 6]
    assert same[0] == same[1]
    assert toxicity.classify(frame(spark, []), model).count() == 0


def test_training_rows(spark):
    """Worst of several labels, no null label or id, one text an id, the bound and the
    condition; without one of the classes there is no model and every score is 0."""
    docs = frame(spark, [(i, f"text {i}") for i in range(40)] + [(1, "other 1"), (None, "null id")])
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(2, 1, "x"), (3, None, "x"), (None, 1, "x")],
                                   "doc_id long, toxic int, text string")
    texts, toxic = toxicity.training_rows(docs, labels)
    marks = dict(zip(texts.to_pylist(), toxic.tolist()))
    assert len(texts) == 40 and marks["text 2"] == 1 and marks["text 3"] == 1 and marks["text 4"] == 0
    texts, _ = toxicity.training_rows(docs, labels, queries.F.col("_l") < 10)
    assert len(texts) == 10
    assert toxicity.train(docs, labels.filter("toxic = 0 and doc_id != 2")) is None
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.classify(docs, None).collect()} == {0.0}
    many = spark.range(20_000).selectExpr("id as doc_id", "concat('w', id) as text", "cast(id % 10 = 0 as int) as toxic")
    texts, toxic = toxicity.training_rows(many, many, rows=1000)
    assert 850 < len(texts) < 1150 and 400 < toxic.sum() < 600


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op13_toxicity(spark, SF01).collect()}
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    rows = [(r["toxic"], got[r["doc_id"]]) for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()
            if r["doc_id"] in got]
    for fold in (False, True):                       # 32 toxic training texts only at this size
        clean = [r["predicted"] for t, r in rows if not t and r["held_out"] == fold]
        assert np.mean(clean) < 0.05
    toxic = [r["predicted"] for t, r in rows if t and not r["held_out"]]
    assert np.mean(toxic) > 0.9
