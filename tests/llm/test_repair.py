"""Conversation repair against dynamic programming and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from custseg.llm import queries, repair
from tests.conftest import SF001

LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def inserted(cur):
    out = dict(cur)
    for _ in range(3):
        for q, (c, a) in list(out.items()):
            z, v = 3 if q == 2 else 2, (c + 2, a + "I")
            if z not in out or v < out[z]:
                out[z] = v
    return out


def by_dynamic_programming(codes, state, goals, tail):
    """Least (cost, audit): every (rows read, state) keeps its least prefix."""
    cur = {state: (0, "")}
    for c in codes:
        new = {}
        for q, (cost, a) in inserted(cur).items():
            own = 1 if c.isupper() else 0
            ways = [(q, cost + 3, a + "D")]
            if not c.isdigit():
                ways.append((3 if q == 2 else 2, cost + 2 + own, a + "R"))
                if (q, c.lower()) in LEGAL:
                    ways.append((LEGAL[q, c.lower()], cost + own, a + "K"))
            for z, x, y in ways:
                if z not in new or (x, y) < new[z]:
                    new[z] = (x, y)
        cur = new
    ends = [v for q, v in (inserted(cur) if tail else cur).items() if q in goals]
    return min(ends) if ends else None


@pytest.mark.parametrize("letters", ["ua", "suaUA0", "suaxSUAX0123"])
def test_search_is_optimal(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, 5, 8, 13, 30, 60]:
        for _ in range(12):
            codes = "".join(rng.choices(letters, k=n))
            for state in range(4):
                for goals, tail in [((0, 3), True), *(((z,), False) for z in range(4))]:
                    assert repair.search(codes, state, goals, tail) == \
                        by_dynamic_programming(codes, state, goals, tail), (codes, state, goals)


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(5)
    for _ in range(300):
        codes = "".join(rng.choices("suaxSUAX0123", k=rng.randrange(9)))
        for state, seen in enumerate("^sua"):
            best = by_dynamic_programming(codes, state, (0, 3), True)
            assert repair.bounds(codes, True)[seen][0] <= best[0]


def expected(rows):
    """Digest row of one conversation: rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, codes, blank, dup, cut = set(), "", 0, 0, 0
    for _, role, text in rows:
        k = role[:1] if role[:1] in ("s", "u", "a") else "x"
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not solid:
            blank += 1
            k = str("suax".index(k))
        elif (role, text) in seen:
            dup += 1
            k = str("suax".index(k))
        elif solid[-1] not in ".!?":
            cut += 1
            k = k.upper()
        seen.add((role, text))
        codes += k
    cost, audit = by_dynamic_programming(codes, 0, (0, 3), True)
    out, q, left = [], 0, list(rows)
    for e in audit:
        if e == "D":
            left.pop(0)
            continue
        role, text = ("", "") if e == "I" else left.pop(0)[1:]
        if e == "K":
            q = LEGAL[q, role[:1]]
        else:
            q = 3 if q == 2 else 2
            role = {2: "user", 3: "assistant"}[q]
        out.append(f"{role}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heads = [r[1][:1] for r in rows]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    return (gaps, blank, dup, cut, wrong, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    """Conversations with extra columns named like internal ones."""
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, _c string, codes string, _p int")


def check(spark, rows):
    plans, repaired = repair.repair(frame(spark, rows))
    sha = {r["conv_id"]: r["repaired_sha256"] for r in repair.digest(repaired).collect()}
    got = {r["conv_id"]: (*[r[f] for f in FIELDS[:-1]], sha[r["conv_id"]]) for r in plans.collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert got == {c: expected(v) for c, v in by.items()}


def test_odd_conversations(spark):
    long = "word " * 200_000
    check(spark, [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
        (2, None, None, None), (2, 4, "user", ""), (2, 4, "user", "\t \n"), (2, 9, "assistant", "cut"),
        (3, None, "user", "a."), (3, None, "user", "a."), (3, None, "assistant", "b!"),          # null turns, repeats
        (None, 0, "assistant", "only one"), (None, 1, "tool", "x?"),
        (4, 0, "system", "S."), (4, 1, "system", "S."), (4, 2, "", "empty role."), (4, 3, "user", long),
        (5, 7, "system", "."), (6, 0, "Ünder", "é."), (7, 1, "user", "same"), (7, 1, "assistant", "same"),
        (7, 1, "user", "same"), (8, 2, "user", "x. "), (9, 3, "user", "  ?  ")])


def test_empty_table(spark):
    plans, rows = repair.repair(frame(spark, []))
    assert plans.count() == 0 and repair.digest(rows).count() == 0


def test_conversations_over_many_blocks(spark, monkeypatch):
    """Blocks of a few rows, in one conversation that holds most rows and has one
    row repeated without end."""
    monkeypatch.setattr(repair, "BLOCK", 4)
    rng = random.Random(3)
    texts = ["One.", "two", "Three!", "", "four?", "five"]
    rows = [(0, rng.randrange(90), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts) + str(rng.randrange(9)))
            for _ in range(150)] + [(0, 50, "user", "again.")] * 80
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(1, 9) for t in range(rng.randrange(1, 12))]
    check(spark, rows)


def test_query_on_a_table(spark):
    rows = spark.read.parquet(f"{SF001}/conversations.parquet").collect()
    by = {r["conv_id"]: [] for r in rows}
    for r in rows:
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role = "user" if kind == 4 else r["role"]
        text = "" if kind == 1 else re.sub("[.!?]", "", r["text"]) if kind == 2 else r["text"]
        by[r["conv_id"]] += [(r["turn"], role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in
           queries.op11_conversation_repair(spark, SF001).collect()}
    assert got == {c: expected(v) if v else none for c, v in by.items()}
