"""Packing by concatenate and cut.

Pass 1 tokenises every document once (ids plus one end id) and writes the ids
with their place inside the partition (``_part``, ``_start``).  The token total
of each partition -- one row per partition -- turns into global offsets by a
prefix sum.  Pass 2 adds a partition's offset to its documents and cuts the one
long stream at multiples of ``length``: every document yields a piece per
window that it touches, and pieces at a window's edge are the boundary records
that join neighbouring partitions.  Only the very last window is not full.

Cases: null and empty text hold the end id alone; a document of any length is
cut into as many pieces as it needs; rows with equal or null id are packed
each; an empty table gives no piece.  Only id and text are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custseg.llm.common import saved

LENGTH = 2048
END_ID = 1
FLUSH_BYTES = 8 << 20

_TOKENS = ("doc_id long, _part int, _start long, doc_tokens long, _ids binary")
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, ids binary")


class Ids:
    """Ids of texts, as 32-bit integers, by a tokenizer file.

    ``ranks`` is the same vocabulary as a rank file: it gives the same ids
    several times faster (the tests compare them).  A text that holds one of
    the special strings is always left to the tokenizer file.
    """

    def __init__(self, path: str, pattern: str, ranks: str | None = None):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=table,
                                          special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> array:
        if self.fast and not any(s in text for s in self.special):
            return array("I", self.fast(text))
        return array("I", self.tok.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def _ids(path: str, pattern: str, ranks: str | None) -> Ids:
    """One per Python worker."""
    return Ids(path, pattern, ranks)


def tokenised(docs: DataFrame, path: str, pattern: str, ranks: str | None = None,
              end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, _part, _start, doc_tokens, _ids``: ids as little-endian integers
    (two bytes each where the vocabulary allows), written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _ids(path, pattern, ranks)
        narrow = max(tok.tok.get_vocab_size(), end_id + 1) <= 1 << 16
        part, place = TaskContext.get().partitionId(), 0
        ids, starts, counts, packed, held = [], [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(packed, pa.binary())],
                names=["doc_id", "_part", "_start", "doc_tokens", "_ids"])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                got = tok(text.as_py() or "")
                got.append(end_id)
                n = len(got)
                got = (np.asarray(got, "<u2") if narrow else np.asarray(got, "<u4")).tobytes()
                ids.append(doc_id.as_py())
                starts.append(place)
                counts.append(n)
                packed.append(got)
                place += n
                held += len(got)
                if held > FLUSH_BYTES:
                    yield flush()
                    ids, starts, counts, packed, held = [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").alias("text"))
    return saved(rows.mapInArrow(encode, _TOKENS), "pack-tokens")


def pack(docs: DataFrame, path: str, pattern: str, ranks: str | None = None,
         length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    ids (little-endian unsigned 32-bit)."""
    tokens = tokenised(docs, path, pattern, ranks, end_id, id_col, text_col)
    # one row per partition of pass 1: bounded by the number of tasks, not by the data
    totals = tokens.groupBy("_part").agg(F.sum("doc_tokens").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [pa.int64()] * 7 + [pa.binary()]
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for doc_id, at, n, raw in zip(b.column("doc_id"), b.column("_at"),
                                          b.column("doc_tokens"), b.column("_ids")):
                doc_id, at, n, raw = doc_id.as_py(), at.as_py(), n.as_py(), raw.as_py()
                wide = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                s = 0
                while s < n:
                    seq, off = divmod(at + s, length)
                    e = min(n, s + length - off)
                    piece = wide[s:e].tobytes()
                    rows.append((doc_id, s, e - s, zlib.crc32(piece), n, seq, off, piece))
                    held += len(piece) + 64
                    s = e
                    if held > FLUSH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    placed = tokens.join(F.broadcast(offsets), "_part").select(
        "doc_id", "doc_tokens", "_ids", (F.col("_off") + F.col("_start")).alias("_at"))
    return placed.mapInArrow(cut, _PIECES)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids end to end, zero-padded to ``length``, the
    lengths of its pieces (document boundaries) and the number of real ids.
    A sequence holds at most ``length`` pieces, so a group is bounded."""
    parts = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("_p"))
    # binary has no aggregate concat: travel as hex inside the row
    body = F.array_join(F.transform("_p", lambda x: F.hex(x["ids"])), "")
    n = F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    pad = F.repeat(F.hex(F.lit(int(pad_id).to_bytes(4, "little"))), (F.lit(length) - n).cast("int"))
    return parts.select("sequence_id", F.unhex(F.concat(body, pad)).alias("ids"),
                        F.transform("_p", lambda x: x["length"]).alias("piece_lengths"),
                        n.alias("n_ids"))
