"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers encode `` text``: A (a byte-level vocabulary) gets the space, B (a
piece vocabulary with byte fallback) adds it.  Tokens are byte strings, so each
token has a byte range; where a token of A and one of B end at the same byte there
is a shared cut, and the cuts divide the text into groups.

Divide and conquer.  A document is an interval.  From the token of A in the
middle of an interval, bisection in B's ends gives the next end there,
bisection in A's ends the next one here, and so on until both agree (to the right
first, then to the left).  The cut found splits the interval and both halves go
on; an interval without a cut inside is a leaf, a group.  All intervals of one
level, over all documents of a run, advance together in numpy.

Links.  Every token of A is linked with every token of B of its group.  The count
of an id pair is the number of documents that hold it linked.

Spark.  One scan encodes and aligns; it writes per document its figures and its
distinct pairs (as places in the chunk's own pair list), and per chunk
(``CHUNK`` bytes of text) that list with document counts.  Only the lists are
shuffled to add up the counts -- a pair that is everywhere costs one row per
chunk -- and are joined back per chunk; then the documents of a chunk follow
their list, sorted behind it, through a streaming pass that holds one list.
Nothing is broadcast and no table of pairs meets in one place.

Cases: null and empty texts, and texts whose tokens do not spell `` text`` byte by
byte, have no tokens: zeros and an empty digest; control strings in a text are
plain text; a group of any size is linked whole, by distinct ids and
multiplicities; repeated rows are documents each; null ids stay; an empty table
gives no row.  A document is one row of work (its tokens are in memory at
once).  Only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custseg.llm.common import runs_of, saved, utf8

RUN = 1 << 19               # bytes of text aligned at once
CHUNK = 1 << 23             # bytes of text that share a pair list
WIDE = 1 << 12              # links of a group beyond which distinct ids are paired


class Table:
    """Byte strings of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries] or [0], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.bits = max(len(entries) - 1, 1).bit_length()

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        n = self.size[ids]
        shift = self.start[ids] - (np.cumsum(n) - n)
        return self.data[np.repeat(shift, n) + np.arange(int(n.sum()))]


class Tokenizers:
    """A from a rank file and its split pattern, B from a piece model."""

    def __init__(self, ranks: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken
        with open(ranks, "rb") as f:
            entries = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self._a = tiktoken.Encoding("align", pat_str=pattern, mergeable_ranks=entries, special_tokens={})
        byte_of = [b""] * (max(entries.values()) + 1)
        for t, r in entries.items():
            byte_of[r] = t
        self.a = Table(byte_of)
        self._b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b = Table([bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and token counts of A, then of B; control strings are plain text."""
        a = [self._a.encode_ordinary(" " + t) for t in texts]
        b = self._b.encode(texts, num_threads=1)
        return (np.fromiter(chain.from_iterable(a), np.int64), np.array([len(x) for x in a], np.int64),
                np.fromiter(chain.from_iterable(b), np.int64), np.array([len(x) for x in b], np.int64))


@lru_cache(maxsize=2)
def tokenizers(ranks: str, pattern: str, model: str) -> Tokenizers:
    """One per Python worker."""
    return Tokenizers(ranks, pattern, model)


# --------------------------------------------------------------------- alignment
def shared_cuts(ea: np.ndarray, eb: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ea`` and ``eb`` of all shared ends, in order.

    ``ea, eb``: ascending byte ends; ``last_a, last_b``: the places of the documents'
    last tokens, which end together."""
    found_a, found_b = [last_a], [last_b]
    lo_a, lo_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
    hi_a, hi_b = last_a, last_b                  # inside an interval: lo <= place < hi
    while True:
        some = (hi_a > lo_a) & (hi_b > lo_b)
        lo_a, lo_b, hi_a, hi_b = lo_a[some], lo_b[some], hi_a[some], hi_b[some]
        if not len(lo_a):
            break
        cut_a = np.full(len(lo_a), -1, np.int64)
        cut_b = cut_a.copy()
        middle = (lo_a + hi_a) >> 1
        # to the right: the first shared end at or after the middle
        left = np.arange(len(lo_a))
        at = middle.copy()
        while len(left):
            x = ea[at]
            other = np.searchsorted(eb, x)
            same = eb[other] == x
            cut_a[left[same]], cut_b[left[same]] = at[same], other[same]
            left, other = left[~same], other[~same]
            at = np.searchsorted(ea, eb[other])
            inside = at < hi_a[left]
            left, at = left[inside], at[inside]
        # to the left where the right has none
        left = np.flatnonzero(cut_a < 0)
        at = middle[left] - 1
        inside = at >= lo_a[left]
        left, at = left[inside], at[inside]
        while len(left):
            x = ea[at]
            other = np.searchsorted(eb, x, side="right") - 1
            inside = other >= lo_b[left]
            left, at, x, other = left[inside], at[inside], x[inside], other[inside]
            same = eb[other] == x
            cut_a[left[same]], cut_b[left[same]] = at[same], other[same]
            left, other = left[~same], other[~same]
            at = np.searchsorted(ea, eb[other], side="right") - 1
            inside = at >= lo_a[left]
            left, at = left[inside], at[inside]
        split = cut_a >= 0
        lo_a, lo_b, hi_a, hi_b, cut_a, cut_b = (x[split] for x in (lo_a, lo_b, hi_a, hi_b, cut_a, cut_b))
        found_a.append(cut_a)
        found_b.append(cut_b)
        lo_a, hi_a = np.concatenate([lo_a, cut_a + 1]), np.concatenate([cut_a, hi_a])
        lo_b, hi_b = np.concatenate([lo_b, cut_b + 1]), np.concatenate([cut_b, hi_b])
        order = np.argsort(lo_a, kind="stable")
        lo_a, lo_b, hi_a, hi_b = lo_a[order], lo_b[order], hi_a[order], hi_b[order]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Run:
    """Aligned tokens of consecutive documents.

    ``fits``: documents with tokens.  Of those, in order: ``a, b`` ids, ``na, nb``
    tokens a document, ``cut_a, cut_b`` the last token of each group, ``groups`` a
    document."""

    def __init__(self, tok: Tokenizers, texts: list[str], data: np.ndarray, off: np.ndarray):
        size = np.diff(off)
        a, na, b, nb = tok.encode(texts)
        doc_a, doc_b = np.repeat(np.arange(len(texts)), na), np.repeat(np.arange(len(texts)), nb)
        fits = (size > 0) & (np.bincount(doc_a, tok.a.size[a], len(texts)) == size + 1) \
            & (np.bincount(doc_b, tok.b.size[b], len(texts)) == size + 1)
        a, b = a[fits[doc_a]], b[fits[doc_b]]
        # byte by byte: a space, then the text
        first = np.concatenate([[0], np.cumsum(size[fits] + 1)])
        want = np.full(first[-1], 32, np.uint8)
        inside = np.ones(first[-1], bool)
        inside[first[:-1]] = False
        want[inside] = data[np.repeat(fits, size)]
        differs = (tok.a.spelled(a) != want) | (tok.b.spelled(b) != want)
        if differs.any():
            wrong = np.add.reduceat(differs, first[:-1]) > 0
            keep_a, keep_b = ~np.repeat(wrong, na[fits]), ~np.repeat(wrong, nb[fits])
            a, b = a[keep_a], b[keep_b]
            fits[np.flatnonzero(fits)[wrong]] = False
        self.fits, self.a, self.b, self.na, self.nb = fits, a, b, na[fits], nb[fits]
        last_a, last_b = np.cumsum(self.na) - 1, np.cumsum(self.nb) - 1
        self.ends = np.cumsum(tok.a.size[a])
        self.cut_a, self.cut_b = shared_cuts(self.ends, np.cumsum(tok.b.size[b]), last_a, last_b)
        self.groups = np.diff(np.concatenate([[0], np.searchsorted(self.cut_a, last_a, side="right")]))
        self.in_a, self.in_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)

    def links(self) -> np.ndarray:
        """Links of every document."""
        return self._per_document(self.in_a * self.in_b)

    def _per_document(self, of_group: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_group)])
        last = np.cumsum(self.groups)
        return total[last] - total[last - self.groups]

    def pairs(self, tok: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document (among those with tokens), id pair and its links there, each
        pair of a document once, sorted."""
        doc = np.repeat(np.arange(len(self.groups)), self.groups)
        of_group = self.in_a * self.in_b
        plain = np.flatnonzero(of_group <= WIDE)
        n = of_group[plain]
        group = np.repeat(plain, n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = self.in_b[group]
        i = self.cut_a[group] - self.in_a[group] + 1 + place // width
        j = self.cut_b[group] - width + 1 + place % width
        shift = tok.a.bits + tok.b.bits
        key = (doc[group] << shift) | (self.a[i] << tok.b.bits) | self.b[j]
        key, times = np.unique(key, return_counts=True)
        wide = np.flatnonzero(of_group > WIDE)
        if len(wide):
            keys, counts = [key], [times]
            for g in wide:
                x, cx = np.unique(self.a[self.cut_a[g] - self.in_a[g] + 1:self.cut_a[g] + 1], return_counts=True)
                y, cy = np.unique(self.b[self.cut_b[g] - self.in_b[g] + 1:self.cut_b[g] + 1], return_counts=True)
                keys.append(((doc[g] << shift) | (x[:, None] << tok.b.bits) | y).ravel())
                counts.append((cx[:, None] * cy).ravel())
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(back, np.concatenate(counts).astype(float)).astype(np.int64)
        return key >> shift, key & ((1 << shift) - 1), times

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all documents end to end, and the offsets."""
        n_a, n_b = len(self.a), len(self.b)
        # place of every token when each group's A tokens are followed by its B tokens
        before = np.cumsum(self.in_a + self.in_b) - self.in_a - self.in_b
        place_a = np.arange(n_a) + np.repeat(before - (np.cumsum(self.in_a) - self.in_a), self.in_a)
        place_b = np.arange(n_b) + np.repeat(before + self.in_a - (np.cumsum(self.in_b) - self.in_b), self.in_b)
        ids, mark = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[self.cut_a]] = ord("|")
        mark[place_b[self.cut_b]] = ord(";")
        digits = np.ones(len(ids), np.int64)
        power = 10
        while len(ids) and power <= ids.max():
            digits += ids >= power
            power *= 10
        end = np.cumsum(digits + 1)
        out = np.empty(end[-1] if len(end) else 0, np.uint8)
        out[end - 1] = mark
        rest, at, alive = ids, end - 2, digits
        while len(rest):
            out[at] = rest % 10 + 48
            more = alive > 1
            rest, at, alive = rest[more] // 10, at[more] - 1, alive[more] - 1
        tokens = np.cumsum(self.na + self.nb)
        return out, np.concatenate([[0], end[tokens - 1]])

    def digests(self) -> list[str]:
        out, off = self.written()
        raw = out.tobytes()
        return [hashlib.sha256(raw[i:j - 1]).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]


def _runs(tok: Tokenizers, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, Run]]:
    """Row range, bytes and alignment of each run of a batch (columns id, text)."""
    data, off = utf8(batch.column(1))
    texts = batch.column(1).fill_null("")
    for i, j in runs_of(off, RUN):
        yield i, j, int(off[j] - off[i]), Run(tok, texts.slice(i, j - i).to_pylist(), data[off[i]:off[j]],
                                              off[i:j + 1] - off[i])


# ------------------------------------------------------------------------- Spark
def groups(docs: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The alignment itself: ``doc_id, ends, a, b`` -- per group its byte end in the
    text with its leading space, A's ids and B's ids (empty arrays without tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(ranks, pattern, model)
        ints = pa.int32()
        for batch in batches:
            for i, j, _, r in _runs(tok, batch):
                count = np.zeros(j - i, np.int64)
                count[r.fits] = r.groups
                of_doc = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                start = np.repeat(np.cumsum(r.na) - r.na, r.groups)
                base = np.where(start > 0, r.ends[start - 1], 0)

                def nested(ids, cut):
                    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cut + 1]), ints), pa.array(ids, ints))
                    return pa.ListArray.from_arrays(pa.array(of_doc), inner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(of_doc), pa.array(r.ends[r.cut_a] - base, pa.int64())),
                     nested(r.a, r.cut_a), nested(r.b, r.cut_b)], names=["doc_id", "ends", "a", "b"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ends array<long>, a array<array<int>>, b array<array<int>>")


_FOUND = ("chunk long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
          "groups_sha256 string, n_pairs int, places binary, times binary, pairs array<bigint>, docs array<int>")
_FOUND_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.binary(), pa.binary(),
                pa.list_(pa.int64()), pa.list_(pa.int32())]
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


class _Chunk:
    """Documents of about ``CHUNK`` bytes, until their pair list is known."""

    def __init__(self, name: int):
        self.name, self.bytes, self.rows, self.keys = name, 0, [], []

    def add(self, ids: list, size: int, r: Run, tok: Tokenizers) -> None:
        self.bytes += size
        doc, pair, times = r.pairs(tok)
        at = np.searchsorted(doc, np.arange(len(r.groups) + 1))
        figures = iter(zip(r.na.tolist(), r.nb.tolist(), r.groups.tolist(), r.links().tolist(), r.digests(),
                           at[:-1].tolist(), at[1:].tolist()))
        for i, fits in zip(ids, r.fits.tolist()):
            if not fits:
                self.rows.append((i, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            *own, s, e = next(figures)
            self.rows.append((i, *own, pair[s:e], times[s:e]))
        self.keys.append(np.unique(pair))

    def batch(self) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate(self.keys))
        docs = np.zeros(len(pairs), np.int64)
        out = []
        for i, na, nb, ng, nl, sha, pair, times in self.rows:
            places = np.searchsorted(pairs, pair)
            docs[places] += 1
            out.append((self.name, 1, i, na, nb, ng, nl, sha, len(pair), _narrow(places).tobytes(),
                        _narrow(times).tobytes(), None, None))
        out.append((self.name, 0, *[None] * 9, pairs, docs.astype(np.int32)))
        for s in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[s:s + 2000]), _FOUND_TYPES)],
                                             names=_FOUND_NAMES)


def _aligned(ranks: str, pattern: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(ranks, pattern, model)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, size, r in _runs(tok, batch):
                chunk.add(ids[i:j], size, r, tok)
                if chunk.bytes >= CHUNK:
                    yield from chunk.batch()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.rows:
            yield from chunk.batch()
    return run


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, kind, place: a chunk's counts, then its documents."""
    current, count, best = None, [], []
    for b in batches:
        chunk, kind = b.column("chunk").to_numpy(), b.column("kind").to_numpy()
        edge = np.flatnonzero(np.diff(chunk) | np.diff(kind)) + 1
        best_sum, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for s, e in zip([0, *edge], [*edge, b.num_rows]):
            if chunk[s] != current:
                current, count, best = chunk[s], [], []
            if kind[s] == 0:
                count.append(b.column("count").slice(s, e - s).to_numpy(zero_copy_only=False).astype(np.int64))
                best.append(b.column("best").slice(s, e - s).to_numpy(zero_copy_only=False).astype(np.int64))
                continue
            if len(count) > 1:
                count, best = [np.concatenate(count)], [np.concatenate(best)]
            for i in range(s, e):
                n = b.column("n_pairs")[i].as_py()
                if n:
                    place = _wide(b.column("places")[i].as_py(), n)
                    times = _wide(b.column("times")[i].as_py(), n)
                    best_sum[i] = best[0][place] @ times
                    count_sum[i] = count[0][place] @ times
        docs = pa.array(np.flatnonzero(kind == 1))
        t = b.take(docs)
        yield pa.RecordBatch.from_arrays(
            [t.column("doc_id"), t.column("n_a"), t.column("n_b"), t.column("n_groups"), t.column("n_links"),
             pa.array(best_sum).take(docs), pa.array(count_sum).take(docs), t.column("groups_sha256")],
            names=[f.split()[0] for f in _SCORED.split(", ")])


def report(docs: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's
    count is the highest of its A id), count_sum (over links), groups_sha256."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = saved(rows.mapInArrow(_aligned(ranks, pattern, model), _FOUND), "align-documents")
    bits = tokenizers(ranks, pattern, model).b.bits
    lists = found.filter("kind = 0").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")) \
        .select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = lists.groupBy("pair").agg(F.sum("docs").alias("count"))
    # at most as many rows an A id as B has ids
    of_a = Window.partitionBy(F.shiftright("pair", bits))
    stats = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    need = lists.select("chunk", "place", "pair").join(stats, "pair").select(
        "chunk", F.lit(0).alias("kind"), "place", "count", "best")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (
        ("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"),
        ("groups_sha256", "string"), ("n_pairs", "int"), ("places", "binary"), ("times", "binary"))]
    per_doc = found.filter("kind = 1").select(
        "chunk", "kind", F.lit(0).alias("place"), F.lit(None).cast("long").alias("count"),
        F.lit(None).cast("boolean").alias("best"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
        "n_pairs", "places", "times")
    return need.select("*", *nothing).unionByName(per_doc).repartition("chunk") \
        .sortWithinPartitions("chunk", "kind", "place").mapInArrow(_scored, _SCORED)
