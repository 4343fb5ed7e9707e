"""Shared helpers of the training-data operators.

``saved`` is the way an operator cuts lineage: the rows are written as Parquet
to the shared folder (``spark.checkpoint.dir``) and read back, so a lost
executor costs a re-read and not a recomputation, and both sides of a later
join are plain scans that adaptive execution can split when a key is hot.

Documents are addressed by two longs: ``_d`` (the id, ``NO_ID`` for null) and
``_t`` (``xxhash64`` of the text).  Two rows that agree in both are the same
row for every operator here, so repeated rows need no generated row number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.session import shared_path

NO_ID = -(1 << 63)          # stands for a null document id inside joins
CHUNK_BYTES = 1 << 20       # text handled at once inside a task
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_d, _t, _text`` of every row; other columns do not travel."""
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_d"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_t"),
        F.col(f"`{text_col}`").alias("_text"))


def id_of(d: str | Column = "_d") -> Column:
    """The document id behind ``_d`` (null for ``NO_ID``)."""
    c = F.col(d) if isinstance(d, str) else d
    return F.when(c != NO_ID, c)


# ---------------------------------------------------------------- text in tasks
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column end to end, and its n + 1 offsets (null: empty)."""
    col = column.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    buf = col.buffers()[2]
    if n == 0 or buf is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buf, dtype=np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def runs_of(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [i, j) of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                 + np.uint64(seed & M64)) | np.uint64(1)


_POWER = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space)
    of each row, end to end, and the n + 1 word offsets of the rows.

    A word's hash is its polynomial value, taken from one running sum over the
    bytes, mixed with its length: no per-word Python work.
    """
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = off[:-1][off[:-1] < len(data)]
    first[starts] = solid[starts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = solid[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        power = np.ones(len(data) + 1, np.uint64)
        power[1:] = _POWER
        power = np.cumprod(power, dtype=np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        # the value relative to the word's own start: divide by power[s]
        back = np.ones(len(data) + 1, np.uint64)
        back[1:] = np.uint64(_inverse(int(_POWER)))
        back = np.cumprod(back, dtype=np.uint64)
        h = (total[e] - total[s]) * back[s] + (e - s).astype(np.uint64)
        mix64(h)
    return h, np.searchsorted(s, off).astype(np.int64)
