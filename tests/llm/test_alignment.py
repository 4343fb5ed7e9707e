"""Token alignment against sets of ends, on whole small tables and odd texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from custseg.llm import alignment, queries
from tests.conftest import SF001

FILES = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
LONG = " ".join(f"word{i * i % 7919}" for i in range(150_000))
ODD = [(1, None), (2, ""), (3, "a▁b"), (4, "  \n\n\tx "), (5, "é" * 70), (6, "😀" * 50), (7, "a" * 4000), (8, " "),
       (9, "<|endoftext|><s></s><unk><0x41>"), (10, "日本語" * 30), (11, "x\x00y"), (12, LONG), (None, "null id"),
       (13, "same text"), (13, "same text"), (14, "ｆｕｌｌ ﬁ ½"), (15, "\r\n" * 40), (16, "0123456789" * 50)]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, alignment.tokenizers(*FILES)


def entry(table, i):
    return bytes(table.data[table.start[i]:table.start[i] + table.size[i]])


def by_sets(both, texts):
    """The contract's columns from the sets of ends of each text."""
    a, tok = both
    per, docs = [], Counter()
    for t in texts:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = tok._b.encode(t) if t else []
        want = (" " + (t or "")).encode()
        ta, tb = [entry(tok.a, x) for x in ia], [entry(tok.b, x) for x in ib]
        if not t or b"".join(ta) != want or b"".join(tb) != want:
            per.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        at_a, at_b = {e: k + 1 for k, e in enumerate(ea)}, {e: k + 1 for k, e in enumerate(eb)}
        links, parts, i, j = Counter(), [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            ga, gb = ia[i:at_a[c]], ib[j:at_b[c]]
            i, j = at_a[c], at_b[c]
            parts.append((ga, gb))
            for x, cx in Counter(ga).items():
                for y, cy in Counter(gb).items():
                    links[x, y] += cx * cy
        docs.update(links.keys())
        per.append((len(ia), len(ib), parts, links))
    top = {}
    for (x, _), c in docs.items():
        top[x] = max(top.get(x, 0), c)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, parts, links = p
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        out.append((na, nb, len(parts), sum(links.values()),
                    sum(c for k, c in links.items() if docs[k] == top[k[0]]),
                    sum(c * docs[k] for k, c in links.items()), hashlib.sha256(line.encode()).hexdigest()))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "x", 1) for i, t in rows],
                                 "doc_id long, text string, chunk string, pairs string, kind int").repartition(parts)


def check(spark, both, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(r[f] for f in FIELDS))
                 for r in alignment.report(frame(spark, rows), *FILES).collect())
    want = by_sets(both, [t for _, t in rows])
    assert got == sorted((i is None, i or 0, w) for (i, _), w in zip(rows, want))


def test_odd_texts(spark, both):
    check(spark, both, ODD)


def test_small_runs_and_chunks(spark, both, monkeypatch):
    """Pair lists of many chunks add up; wide groups are linked by multiplicities."""
    monkeypatch.setattr(alignment, "CHUNK", 2000)
    monkeypatch.setattr(alignment, "RUN", 700)
    monkeypatch.setattr(alignment, "WIDE", 2)
    check(spark, both, [r for r in ODD if r[0] != 12] + [(100 + i, f"text number {i % 7} is here, here") for i in range(60)])


def test_query_on_a_table(spark, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in rows], by_sets(both, [t for _, t in rows])))
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in queries.op12_token_alignment(spark, SF001).collect()}
    assert got == want


def test_groups_spell_the_text(spark, both):
    _, tok = both
    rows = [r for r in ODD if r[0] not in (None, 13)]
    for r in alignment.groups(frame(spark, rows), *FILES).collect():
        text = dict(rows)[r["doc_id"]]
        for ids, table in ((r["a"], tok.a), (r["b"], tok.b)):
            parts = [b"".join(entry(table, x) for x in g) for g in ids]
            assert np.cumsum([len(p) for p in parts]).tolist() == r["ends"]
            assert not parts or b"".join(parts) == (" " + text).encode()


def test_empty_table(spark):
    assert alignment.report(frame(spark, []), *FILES).count() == 0


def test_shared_cuts_of_random_ends():
    rng = np.random.default_rng(4)
    for share in (0.02, 0.3, 0.9):
        n = 3000
        ea, eb = np.flatnonzero(rng.random(n) < share), np.flatnonzero(rng.random(n) < share)
        ends = np.sort(rng.choice(n, 5, replace=False))
        ea, eb = np.union1d(ea[ea < ends[-1]], ends), np.union1d(eb[eb < ends[-1]], ends)
        a, b = alignment.shared_cuts(ea, eb, np.searchsorted(ea, ends), np.searchsorted(eb, ends))
        assert ea[a].tolist() == eb[b].tolist() == np.intersect1d(ea, eb).tolist()
