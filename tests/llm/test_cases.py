"""Cases of the searches and of revisits that were undefined before."""

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from custseg.llm import ann, maxscore, warc

VEC = "vec_id long, embedding array<double>, ids string, score int, dim int"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VEC)


def scores_by_hand(rows):
    """Top 10 by the exact integer product, kept in the range of a long."""
    def whole(x):
        return int(x) * 1024 if abs(x) >= 2.0 ** 53 else int((x * 1024) // 1)
    out, top = {}, (1 << 63) - 1
    for q, a in rows:
        if q is None or q % 100:
            continue
        got = []
        for i, b in rows:
            if i != q and len(a) == len(b):
                s = sum(whole(x) * whole(y) for x, y in zip(a, b))
                got.append((-min(max(s, -top - 1), top), i is None, i or 0))
        out[q] = [(None if none else i, -s) for s, none, i in sorted(got)[:10]]
    return out


def test_maxscore_of_large_finite_vectors(spark):
    rows = [(100, [1e8] * 4), (200, [1e8] * 4), (300, [1e200, 1.0, 0.0, 0.0]), (400, [1e306, -1e306, 1.0, 2.0]),
            (5, [0.0, 0.5, 0.25, 1.0]), (None, [2.0, 1.0, 1.0, 1.0]), (6, [-1e307, 0.0, 0.0, 0.0]), (7, [1.0, 1.0])]
    rows += [(i, [float(i % 5), 1.0, -0.5, i / 7]) for i in range(500, 560)]
    want = scores_by_hand(rows)
    got = {q: [] for q in want}
    for r in maxscore.search_embeddings(vectors_frame(spark, rows)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == want


def test_null_ids_are_candidates(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0])]
    df = vectors_frame(spark, rows)
    near = [r["vec_id"] for r in ann.search_embeddings(df).orderBy("query_id", "rank").collect()]
    assert near == [1, None, 2, None]
    best = [r["vec_id"] for r in maxscore.search_embeddings(df).orderBy("query_id", "rank").collect()]
    assert best == [1, None, 2, 4, None]


RECORDS = ("record_id long, kind string, url string, time long, etag string, last_modified string, "
           "headers map<string,string>, payload string, status string, _u string")


def test_revisit_cases(spark):
    rows = [
        (1, "response", "http://a.org/x", 10, '"e"', None, {"ETag": "e", "Date": "1", "Server": "s"}, "body"),
        (1, "response", "http://a.org/x", 10, '"e"', None, {"ETag": "e", "Date": "1", "Server": "s"}, "body"),   # repeated
        (2, "revisit", "https://www.a.org/x/", 20, 'W/"e"', None, {"DATE": "2", "etag": "f", "X-Own": "no", "Etag": "g"}, None),
        (2, "revisit", "https://www.a.org/x/", 20, 'W/"e"', None, {"DATE": "2", "etag": "f", "X-Own": "no", "Etag": "g"}, None),
        (3, None, "http://a.org/x", 30, None, None, None, None),
        (4, "revisit", None, 30, '"e"', None, None, None), (5, "revisit", "http://a.org/x", None, '"e"', None, None, None),
        (6, "response", None, 5, '"e"', None, None, "lost"), (7, "response", "http://a.org/x", None, '"e"', None, None, "lost"),
        (8, "revisit", "http://a.org/x", 10, '"e"', None, None, None)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], RECORDS)
    got = sorted((r["record_id"], r["status"], r["target_id"], r["payload"]) for r in warc.resolve(df).collect())
    assert got == [(2, "resolved", 1, "body"), (2, "resolved", 1, "body"), (4, "missing", None, None),
                   (5, "missing", None, None), (8, "missing", None, None)]
    headers = warc.resolve(df).filter("record_id = 2").first()["headers"]
    assert headers == {"server": "s", "date": "2", "etag": "g"}         # names ignore case; "Etag" sorts first
    assert warc.resolve(df.limit(0)).count() == 0
    plan = warc.resolve(df.filter(F.col("url").isNull()))
    assert {r["status"] for r in plan.collect()} == {"missing"}


def test_least_long_is_last_in_a_block(spark):
    rows = [(100, [1e306, 1.0])] + [(i, [float(i), 0.0]) for i in range(1, 12)] + [(50, [-1e306, 0.0])]
    want = scores_by_hand(rows)
    got = {q: [] for q in want}
    for r in maxscore.search_embeddings(vectors_frame(spark, rows).coalesce(1)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == want


def normal_rows(n, dim, seed=5):
    return np.random.default_rng(seed).standard_normal((n, dim))


def test_maxscore_carries_the_score_to_beat(spark, tmp_path):
    x = normal_rows(9000, 24)
    x[4000:4020] = x[100] * 2                                      # ties, over two blocks with 8100
    x[8100] = x[4000]
    pq.write_table(pa.table({"vec_id": np.arange(9000), "embedding": list(x)}), tmp_path / "e.parquet")
    df = spark.read.parquet(str(tmp_path / "e.parquet"))
    assert df.rdd.glom().map(len).filter(lambda n: n > 0).count() == 1         # three blocks in one task
    whole = np.floor(x * 1024).astype(np.int64)
    got = {}
    for r in maxscore.search_embeddings(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 9000, 100):
        s = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(9000), -s)) if i != q][:10]
        assert got[q] == [(int(i), int(s[i])) for i in best]


def test_maxscore_splits_terms_by_bounds():
    x = normal_rows(3000, 24)
    x[:, 12:] *= 0.01                                              # half of the terms cannot lift a row
    ids = np.arange(3000, dtype="<i8")
    row = {"dim": 24, "q_ids": ids[:1].tobytes(), "ids": ids.tobytes()}
    m, row["extra"] = maxscore._postings(x)
    row["mat"] = m.tobytes()
    q, row["q_extra"] = maxscore._scaled(x[:1])
    row["q_mat"] = q.tobytes()
    low, high = np.frombuffer(row["extra"], "<f8").reshape(2, 24)
    least, most = np.minimum(q[0] * low, q[0] * high), np.maximum(q[0] * low, q[0] * high)
    scores = np.floor(x * 1024) @ q[0]
    bar = np.sort(scores[1:])[-10]
    order, essential, rest = maxscore._split(least, most, bar)
    assert 0 < essential <= 12 and set(order[:essential]) <= set(range(12))
    assert least.sum() + (most - least)[order[essential:]].sum() < bar
    assert least.sum() + (most - least)[order[essential - 1:]].sum() >= bar
    carried = OrderedDict()
    (_, _, first), = maxscore._find(row, 10, carried)
    (_, again, _), = maxscore._find(row, 10, carried)
    assert len(first) >= 256 and sorted(again) == sorted(np.argsort(-scores[1:], kind="stable")[:10] + 1)


@pytest.mark.parametrize("dim", [16, 64, 384, 1024])
def test_ann_recall_on_a_full_block(dim):
    """Normal vectors have no clusters: the nearest are hardly nearer than the rest."""
    n, queries = ann._block_rows(dim), 30
    x = normal_rows(n, dim)
    mat, extra = ann._sorted_arrays(x)
    ids = np.arange(n, dtype="<i8")
    row = {"dim": dim, "ids": ids.tobytes(), "mat": mat.tobytes(), "extra": extra,
           "q_ids": ids[:queries].tobytes(), "q_mat": x[:queries].tobytes()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = verified = 0
    for q, found, scores in ann._find(row, 5):
        verified += len(found)
        s = unit @ unit[q]
        assert np.allclose(s[found], scores)
        s[q] = -2
        hit += len(set(found[np.argsort(-scores)[:5]]) & set(np.argsort(-s)[:5]))
    assert hit >= 0.9 * 5 * queries
    assert verified <= 0.35 * n * queries                          # the windows chose; not all was compared
