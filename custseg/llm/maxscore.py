"""Exact top-k by MaxScore over integer vectors.

A dimension is a term, its postings are the components of all rows, and a
query's component is the term's weight.  Each block (shard) stores its postings
term by term with the least and the greatest component of every term, so a term
contributes at most ``max(q * least, q * greatest)`` to any row of the block.

A row of a query has at least the sum of its terms' least contributions, and each
term can add its spread (greatest less least contribution) to that.  The terms are
ordered by spread and split by the score to beat: the non-essential terms are the
longest run of smallest spreads that cannot lift a row from the least sum to the
k-th best score known.  Postings of essential terms are traversed for all rows;
the other terms are probed, a few at a time, for the rows whose partial score plus
the bounds of the unread terms still reaches that score.

The k best scores of a query are carried from block to block within a task, for the
``KEPT_CHUNKS`` chunks of queries used last; a query met for the first time takes
its first threshold from ``FIRST_ROWS`` rows scored fully.  A threshold only
decides what is skipped, so results do not depend on the order of blocks.  The
shards' k best are merged per query; ties go to the smaller id.

Arithmetic is on integers: in doubles while twice every sum stays below 2**53, which
is exact, and on Python integers otherwise.  A score beyond the range of a long
counts as the greatest or least long; blocks in which one is possible are scored
without bounds.

Cases: vectors null, empty or with null or non-finite components take no part;
a query with fewer than k candidates gets all of them; rows with equal ids are
candidates each, but never for their own id; a null id is a candidate, last among
ties, and no query; vectors of unlike length never
meet; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame

from custseg.llm import vectors

SCALE = 1024
TOP = 10
EVERY = 100
BLOCK_ROWS = 4096
CHUNK_ROWS = 512
FIRST_ROWS = 256
TERM_GROUP = 8
KEPT_CHUNKS = 256
EXACT = 2.0 ** 52
LONG = (1 << 63) - 1


def _scaled(mat: np.ndarray) -> tuple[np.ndarray, bytes]:
    """``floor(SCALE * x)`` in doubles, or the vectors themselves (marked ``raw``) where
    that leaves the range of a double."""
    with np.errstate(over="ignore"):
        x = np.floor(mat * float(SCALE))
    return (x, b"") if np.isfinite(x).all() else (mat, b"raw")


def _whole(mat: np.ndarray, raw: bool) -> np.ndarray:
    """Python integers of a stored matrix."""
    def one(v):
        return int(v) if not raw else int(v) * SCALE if abs(v) >= 2.0 ** 53 else int(np.floor(v * SCALE))
    return np.array([one(v) for v in mat.ravel().tolist()], object).reshape(mat.shape)


def _postings(mat: np.ndarray) -> tuple[np.ndarray, bytes]:
    x, mark = _scaled(mat)
    x = np.ascontiguousarray(x.T)                        # a row per term
    return x, mark or np.concatenate([x.min(1), x.max(1)]).tobytes()


def _every_row(q_ids, queries, ids, terms):
    """Scores of all rows, exactly, kept in the range of a long."""
    for qid, q in zip(q_ids, queries):
        other = np.flatnonzero(ids != qid)
        scores = [min(max(int(v), -LONG - 1), LONG) for v in (q @ terms[:, other]).tolist()]
        yield int(qid), ids[other], np.array(scores, np.int64)


def _split(least: np.ndarray, most: np.ndarray, bar) -> tuple[np.ndarray, int, np.ndarray]:
    """The terms by falling spread, how many of them are essential for the score ``bar``,
    and the greatest sum of the terms from each place on."""
    spread = most - least
    order = np.argsort(-spread if spread.dtype != object else [-float(x) for x in spread], kind="stable")
    ends = lambda v: np.concatenate([np.cumsum(v[order][::-1])[::-1], [0 * v[0]]])
    lifted = ends(spread) + least.sum()
    short = np.flatnonzero(lifted < bar)
    return order, int(short[0]) if len(short) else len(order), ends(most)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    return scores if len(scores) <= k else np.partition(scores, len(scores) - k)[-k:]


def _known(carried: OrderedDict, row: dict) -> list:
    """The k best scores so far of each query of the row's chunk."""
    key = hashlib.sha256(row["q_ids"] + row["q_mat"] + row["q_extra"]).digest()
    if key not in carried:
        carried[key] = [np.zeros(0, np.int64)] * (len(row["q_ids"]) // 8)
        if len(carried) > KEPT_CHUNKS:
            carried.popitem(last=False)
    carried.move_to_end(key)
    return carried[key]


def _find(row: dict, k: int, carried: OrderedDict):
    dim = row["dim"]
    ids, q_ids = vectors.ids_of(row["ids"]), vectors.ids_of(row["q_ids"])
    terms = np.frombuffer(row["mat"], "<f8").reshape(dim, -1)
    queries = np.frombuffer(row["q_mat"], "<f8").reshape(-1, dim)
    raw, q_raw = row["extra"] == b"raw", row["q_extra"] == b"raw"
    reach = np.inf
    if not raw and not q_raw:
        low, high = np.frombuffer(row["extra"], "<f8").reshape(2, dim)
        with np.errstate(over="ignore"):
            reach = max(float(np.abs(low).max()), float(np.abs(high).max())) * float(np.abs(queries).max()) * dim
    if reach >= EXACT:
        terms, queries = _whole(terms, raw), _whole(queries, q_raw)
        if reach >= 2.0 ** 62:
            yield from _every_row(q_ids, queries, ids, terms)
            return
        low, high = _whole(low, False), _whole(high, False)
    known = _known(carried, row)
    for i, (qid, q) in enumerate(zip(q_ids, queries)):
        other = np.flatnonzero(ids != qid)
        first = other[:max(FIRST_ROWS, k)] if len(known[i]) < k else other[:0]
        scores = np.asarray(q @ terms[:, first], np.int64)
        best = _best(np.concatenate([known[i], scores]), k)
        alive = other[len(first):]
        if len(alive):
            bar = int(best.min())
            order, essential, rest = _split(np.minimum(q * low, q * high), np.maximum(q * low, q * high), bar)
            lead = order[:essential]
            part = q[lead] @ terms[lead] if essential else np.zeros(len(ids), terms.dtype)
            alive = alive[part[alive] + rest[essential] >= bar]
            for start in range(essential, dim, TERM_GROUP):
                if not len(alive):
                    break
                group = order[start:start + TERM_GROUP]
                part[alive] += q[group] @ terms[np.ix_(group, alive)]
                alive = alive[part[alive] + rest[min(start + TERM_GROUP, dim)] >= bar]
            late = np.asarray(part[alive], np.int64)
            best = _best(np.concatenate([best, late]), k)
            first, scores = np.concatenate([first, alive]), np.concatenate([scores, late])
        known[i] = best
        yield int(qid), ids[first], scores


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows ``vec_id, v`` on both sides."""
    blocks = vectors.packed(candidates, BLOCK_ROWS, "maxscore-blocks", _postings)
    chunks = vectors.packed(queries, CHUNK_ROWS, "maxscore-queries", _scaled)
    carried: OrderedDict = OrderedDict()                 # every task fills its own
    return vectors.search(chunks, blocks, k, "long", lambda row: _find(row, k, carried))


def search_embeddings(embeddings: DataFrame, every: int = EVERY, k: int = TOP,
                      id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    rows = vectors.clean(embeddings, id_col, vec_col, drop_zero=False)
    return top_k(rows, rows.filter(vectors.every(every)), k)
