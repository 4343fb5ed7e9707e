"""Blocks of vectors, for the two exact-or-verified searches over embeddings.

The stated queries meet all rows block by block: rows are packed into blocks of
at most ``block_rows`` vectors (one binary each) and queries into chunks, and
each (block, chunk) pair is one unit of work that returns the block's best rows
for each query of the chunk; the blocks' answers are merged per query.  A block
holds what its operator wants as its index (``extra``), built once and written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custseg.llm.common import saved

NULL_ID = (1 << 63) - 1      # stands for a null id: a candidate like any other, last among ties
_PACKED = "ids binary, mat binary, extra binary, dim int"
_NAMES = ["ids", "mat", "extra", "dim"]


def clean(df: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """``vec_id, v`` (array<double>) without vectors that are null, empty, hold
    null or non-finite components or (``drop_zero``) are zero.  Rows with a null id
    stay as candidates."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("vec_id"), v.alias("v")) \
        .filter("v is not null and size(v) > 0").filter(~bad)
    return rows.filter(F.exists("v", lambda x: x != 0.0)) if drop_zero else rows


def packed(rows: DataFrame, block_rows: int | Callable[[int], int], name: str,
           prepare: Callable[[np.ndarray], tuple[np.ndarray, bytes]]) -> DataFrame:
    """Blocks of ``rows``, of at most ``block_rows`` (a number, or one for each vector length);
    ``prepare`` turns the matrix into what is stored and its index.
    Vectors of different lengths never share a block."""
    most = block_rows if callable(block_rows) else lambda dim: block_rows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def emit(dim):
            ids, mats = held.pop(dim)
            ids, mat = np.concatenate(ids), np.concatenate(mats)
            n = most(dim)
            for i in range(0, len(ids), n):
                order = np.argsort(ids[i:i + n], kind="stable")
                m, extra = prepare(mat[i:i + n][order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i:i + n][order].astype("<i8").tobytes()], pa.binary()),
                     pa.array([m.tobytes()], pa.binary()), pa.array([extra], pa.binary()),
                     pa.array([dim], pa.int32())], names=_NAMES)

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            col = b.column(1)
            size = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                mat = flat[start[own][:, None] + np.arange(dim)]
                a, m = held.setdefault(int(dim), ([], []))
                a.append(ids[own])
                m.append(mat)
                if sum(map(len, a)) >= most(int(dim)):
                    yield from emit(int(dim))
        for dim in list(held):
            yield from emit(dim)

    return saved(rows.mapInArrow(pack, _PACKED), name)


def search(queries: DataFrame, blocks: DataFrame, k: int, score_type: str,
           find: Callable[..., Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """``query_id, rank, vec_id, score``: ``find(row)`` yields for each query of a (block,
    chunk) pair ids and scores of the block, among them all that belong to its ``k`` best."""
    q = queries.select(F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"),
                       F.col("extra").alias("q_extra"), F.col("dim").alias("q_dim"))
    arrow = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["dim"] != row["q_dim"]:
                    continue
                out_q, out_v, out_s = [], [], []
                for qid, ids, scores in find(row):
                    down = ~scores if score_type == "long" else -scores     # the least long has no negative
                    order = np.lexsort((ids, down))[:k]
                    out_q.append(np.full(len(order), qid, np.int64))
                    out_v.append(ids[order])
                    out_s.append(scores[order])
                if out_q:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)),
                         pa.array(np.concatenate(out_s), arrow)], names=["query_id", "vec_id", "score"])

    # the stated queries against all rows, in blocks: a few wide rows on either side,
    # paired without moving a block
    pairs = blocks.crossJoin(q)
    found = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score")


def every(n: int) -> Column:
    """The stated query set: ids divisible by ``n``."""
    return F.col("vec_id") % n == 0


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")
