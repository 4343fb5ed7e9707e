"""Removal of long repeated passages by merging shard Burrows-Wheeler transforms.

A byte-by-byte interleave needs as many passes as the match is long (200).  The
merge here runs over phrases, which is exact for matches of ``length`` bytes:

*Phrases.*  In every window of ``length`` bytes the ``GRAM``-byte string of least
hash is the window's anchor (the last one of equals).  It depends on the
window's bytes alone, so equal windows have equal anchors at equal places.
Consecutive windows with one anchor form a run, about 75 windows; a run's
context is the text that its windows cover.  Suffixes are kept per run, not per
byte: one begins at its anchor, its context says how it goes on to the right and
which bytes precede it on the left.

*Interleave refinement.*  The shards' (partitions') suffixes are interleaved into
blocks of equal common text, and only blocks whose members still differ are
refined; every other block is settled.
1. Blocks by gram (``GRAM`` common bytes).  A run whose gram occurs once has no
   repeated window.  In a gram block with a single context every window repeats,
   and so do all windows of a context that occurs twice.
2. What is left are gram blocks with several contexts, where repeats begin or
   end.  A window is known by how many bytes of it lie left of the anchor.  A
   node is a stretch of ``step`` such numbers; all its windows share ``length`` -
   ``step`` + 1 bytes around the anchor, the common text of the node's block.
   A node without a partner has no repeated window.  A node whose members agree
   in all windows of the stretch repeats whole.  Any other node contains the
   border of a repeated interval and is refined to the nodes of the next of
   ``STEPS``; at the last one a node is a window, and its block decides.

This is the merge's refinement by common prefixes, with long steps in place of a
byte a pass, over hashes of the common texts in place of a written transform.  A
context has at most ``length`` / ``STEPS[0]`` nodes in the first pass and one or
two borders with each later pass, however many runs a block holds: no step works on
pairs, none takes a block into one task, and none depends on a block's size.
Copies are one context with a count.  Blocks are known by the 64-bit hash of the
gram and, inside it, by a second 64-bit hash of the longer text (non-linear
mixing), so a false match needs two equal grams with differing contexts.

Result: each byte covered by a repeated ``length``-byte string is removed, both
in all copies and inside one document; strings are judged on the input.

Cases: null text is empty; texts shorter than ``length`` stay as they are; texts
of any length are read in overlapping pieces of ``CHUNK_BYTES``; repeated rows
remove each other; an empty table gives an empty result; other columns pass
through untouched (internal names start with ``_sd_``).  ``kept`` as a string
drops the torn halves of characters that a cut byte range leaves behind;
``kept_sha256`` is of the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custseg.llm.common import CHUNK_BYTES, runs_of, saved, seeds, utf8

LENGTH = 200
GRAM = 32
STEPS = (28, 7, 1)               # windows of a node in each pass of the refinement
SHIFT = 1 << 16

U = np.uint64
_BYTE = seeds(256, 1)
_STEP = seeds(64, 2)


def _join(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    x = a * _STEP[i]
    x += b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``GRAM`` and of the ``length`` bytes from each place (by doubling)."""
    by = {1: _BYTE[data]}
    n = 1
    while 2 * n <= length:
        by[2 * n] = _join(by[n][:-n], by[n][n:], n.bit_length())
        n *= 2
    gram = by[GRAM]
    out, done = by[n], n
    m = len(data) - length + 1
    out = out[:m]
    while done < length:
        k = 1 << ((length - done).bit_length() - 1)
        out = _join(out, by[k][done:done + m], 20 + done.bit_length())
        done += k
    return gram, out


def anchors(gram: np.ndarray, span: int) -> np.ndarray:
    """For each place the place of the least gram hash among the next ``span``."""
    low = U(0xFFFFFFFF)
    least = (gram & ~low) | (low - np.arange(len(gram), dtype=U))
    n = 1
    while 2 * n <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < span:
        least = np.minimum(least[:n - span], least[span - n:])
    return (low - (least & low)).astype(np.int64)


class Runs:
    """Runs of one piece of text: row, first window ``s`` and last ``e`` (places in
    the piece), anchor, gram and context hash; ``windows`` holds all window hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        self.row = self.s = self.e = self.anchor = np.zeros(0, np.int64)
        self.gram = self.context = self.windows = np.zeros(0, U)
        if len(data) < length:
            return
        gram, self.windows = hashes(data, length)
        at = anchors(gram, length - GRAM + 1)
        fits = np.zeros(len(data) + 1, np.int32)
        n = np.diff(off)
        own = n >= length
        np.add.at(fits, off[:-1][own], 1)
        np.add.at(fits, off[1:][own] - length + 1, -1)
        v = np.flatnonzero(np.cumsum(fits)[:len(self.windows)])
        if not len(v):
            return
        a = at[v]
        cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(v) != 1)) + 1
        self.s = v[np.concatenate([[0], cut])]
        self.e = v[np.concatenate([cut - 1, [len(v) - 1]])]
        self.anchor = at[self.s]
        self.row = np.searchsorted(off, self.s, side="right") - 1
        self.gram = gram[self.anchor]
        shape = (self.e - self.s) * SHIFT + (self.anchor - self.s)
        self.context = _join(_join(self.windows[self.s], self.windows[self.e], 40), shape.astype(U), 41)


def pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the piece in its row, bytes, offsets): rows together up
    to ``CHUNK_BYTES``, a longer row in pieces that overlap by ``length`` - 1."""
    for i, j in runs_of(off):
        size = int(off[j] - off[i])
        if j == i + 1 and size > CHUNK_BYTES:
            for p in range(0, size - length + 1, CHUNK_BYTES):
                part = data[off[i] + p:min(off[i] + p + CHUNK_BYTES + length - 1, off[j])]
                yield i, p, part, np.array([0, len(part)])
        else:
            yield i, 0, data[off[i]:off[j]], off[i:j + 1] - off[i]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _scan_runs(length: int, blocks_only: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            data, off = utf8(b.column(1))
            for row, place, part, o in pieces(data, off, length):
                r = Runs(part, o, length)
                if not len(r.s):
                    continue
                if blocks_only:
                    yield _batch(gram=_long(r.gram), context=_long(r.context))
                else:
                    yield _batch(k=_long(key[row + r.row]), s=_long(r.s - o[r.row] + place),
                                 n=pa.array((r.e - r.s + 1).astype(np.int32), pa.int32()),
                                 gram=_long(r.gram), context=_long(r.context))
    return scan


def _contexts(length: int):
    """Text of the wanted contexts of a document, and the place of the anchor in it."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("_sd_text"))
            wanted = b.column("wanted").to_pylist()
            for row, _, part, o in pieces(data, off, length):
                r = Runs(part, o, length)
                grams, ours = r.gram.view(np.int64), r.context.view(np.int64)
                out: dict[str, list] = {"gram": [], "context": [], "anchor": [], "text": []}
                for i in np.unique(r.row):
                    mine = np.flatnonzero(r.row == i)
                    want = {(w["gram"], w["context"]) for w in wanted[row + i]}
                    known = np.fromiter((c for _, c in want), np.int64, len(want))
                    for j in mine[np.isin(ours[mine], known)]:
                        block = int(grams[j]), int(ours[j])
                        if block not in want:
                            continue
                        want.remove(block)
                        out["gram"].append(block[0])
                        out["context"].append(block[1])
                        out["anchor"].append(int(r.anchor[j] - r.s[j]))
                        out["text"].append(part[r.s[j]:r.e[j] + length].tobytes())
                if out["gram"]:
                    yield _batch(gram=pa.array(out["gram"], pa.int64()),
                                 context=pa.array(out["context"], pa.int64()),
                                 anchor=pa.array(out["anchor"], pa.int32()),
                                 text=pa.array(out["text"], pa.binary()))
    return scan


def _children(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from ``first`` to ``last`` of each row, and its row."""
    n = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def nodes_of(anchor: np.ndarray, data: np.ndarray, off: np.ndarray, length: int, step: int,
             above: tuple[np.ndarray, np.ndarray, int] | None = None):
    """The nodes of contexts (``data, off``) for one pass: row, node, hash of the common
    text, hash of the text of all own windows in the stretch, and these windows' least and
    greatest number of bytes left of the anchor.  ``above`` = rows, nodes and step of the
    nodes that are refined (none: all nodes)."""
    high = anchor
    low = anchor - (np.diff(off) - length)
    if above is None:
        row, node = _children(low // step, high // step)
    else:
        rows, nodes, wide = above
        at, node = _children(np.maximum(nodes * wide, low[rows]) // step,
                             np.minimum(nodes * wide + wide - 1, high[rows]) // step)
        row = rows[at]
    first = node * step
    last = np.minimum(first + step - 1, length - GRAM)
    lo, hi = np.maximum(first, low[row]), np.minimum(last, high[row])
    if above is not None:                    # steps need not divide each other
        lo = np.maximum(lo, nodes[at] * wide)
        hi = np.minimum(hi, nodes[at] * wide + wide - 1)
    size = 2 * length // 3                   # two such hashes cover any text asked for here
    _, h = hashes(data, size)
    zero = off[row] + anchor[row]            # the anchor

    def text_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of the bytes from ``left`` before the anchor to ``length - right`` after it."""
        a, z = zero - left, zero + length - right
        return _join(_join(h[a], h[z - size], 42), (left * SHIFT + right).astype(U), 43)
    return row, node, text_hash(first, last), text_hash(hi, lo), lo, hi


def _nodes(length: int, step: int, wide: int | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                data, off = utf8(part.column("text"))
                above = None
                if wide is not None:
                    held = part.column("nodes").to_pylist()
                    rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
                    above = rows, np.array([x for one in held for x in one], np.int64), wide
                anchor = part.column("anchor").to_numpy().astype(np.int64)
                row, node, key, whole, lo, hi = nodes_of(anchor, data, off, length, step, above)
                yield _batch(gram=_long(part.column("gram").to_numpy()[row]),
                             context=_long(part.column("context").to_numpy()[row]),
                             node=pa.array(node.astype(np.int32), pa.int32()), key=_long(key), whole=_long(whole),
                             place=pa.array((anchor[row] - hi).astype(np.int32), pa.int32()),
                             many=pa.array((hi - lo + 1).astype(np.int32), pa.int32()))
    return scan


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """``gram, context, place, many``: stretches of windows that another context of the
    gram has too.  ``texts``: one row per context (gram, context, anchor, text)."""
    found, live, wide = [], texts, None
    for step in STEPS:
        nodes = saved(live.mapInArrow(_nodes(length, step, wide), "gram long, context long, node int, "
                                      "key long, whole long, place int, many int"), "repeats-nodes")
        blocks = nodes.groupBy("gram", "node", "key").agg(
            F.min("context").alias("c0"), F.max("context").alias("c1"),
            (F.min("whole") == F.max("whole")).alias("same")).filter("c0 <> c1").select(
            F.col("gram").alias("_g"), F.col("node").alias("_n"), F.col("key").alias("_k"), "same")
        met = saved(nodes.join(blocks, (F.col("gram") == F.col("_g")) & (F.col("node") == F.col("_n"))
                               & (F.col("key") == F.col("_k")))
                    .select("gram", "context", "node", "place", "many", "same"), "repeats-met")
        found.append(met.filter("same").select("gram", "context", "place", "many"))
        open_ = met.filter("not same").groupBy(F.col("gram").alias("_g"), F.col("context").alias("_c")).agg(
            F.array_sort(F.collect_set("node")).alias("nodes"))
        live = texts.join(open_, (F.col("gram") == F.col("_g")) & (F.col("context") == F.col("_c"))).select(
            "gram", "context", "anchor", "text", "nodes")
        wide = step
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(length: int, names: list[str], as_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("_sd_text"))
            spans = b.column("spans").to_pylist()
            n_removed, n_spans, sha, kept = [], [], [], []
            for i in range(b.num_rows):
                text = data[off[i]:off[i + 1]]
                if spans[i]:
                    step = np.zeros(len(text) + 1, np.int32)
                    for s in spans[i]:
                        for p in s["places"] or [{"place": 0, "many": s["n"]}]:
                            step[s["s"] + p["place"]] += 1
                            step[s["s"] + p["place"] + p["many"] - 1 + length] -= 1
                    covered = np.cumsum(step)[:-1] > 0
                    n_removed.append(int(covered.sum()))
                    n_spans.append(int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum()))
                    text = text[~covered]
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                raw = text.tobytes()
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw.decode("utf-8", "ignore") if as_text else raw)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(np.diff(off), pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept, pa.string() if as_text else pa.binary())],
                names=[*[f"c{i}" for i in range(len(names))], "n_bytes", "n_removed", "n_spans",
                       "kept_sha256", "kept"])
    return scan


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                   text_col: str = "text", keep: list[str] | None = None,
                   as_text: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: the id), then n_bytes, n_removed, n_spans,
    kept_sha256 and kept (the remaining bytes, or ``as_text`` as a string)."""
    keep = [id_col] if keep is None else keep
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    short = docs.select(key.alias("k"), F.col(f"`{text_col}`").alias("_sd_text"))

    # 1: blocks by gram; only counts and the least and greatest context meet
    grams = short.mapInArrow(_scan_runs(length, True), "gram long, context long")
    blocks = saved(grams.groupBy("gram").agg(
        F.count(F.lit(1)).alias("runs"), F.min("context").alias("c0"), F.max("context").alias("c1"))
        .filter("runs > 1").select(F.col("gram").alias("_gram"), "runs", (F.col("c0") == F.col("c1")).alias("one")),
        "repeats-blocks")
    # 1: the suffixes of those blocks
    runs = short.mapInArrow(_scan_runs(length, False), "k long, s long, n int, gram long, context long")
    active = saved(runs.join(blocks, F.col("gram") == F.col("_gram"))
                   .select("k", "s", "n", "gram", "context", "one"), "repeats-runs")
    contexts = saved(active.filter("not one").groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("times"), F.min("k").alias("k")), "repeats-contexts")
    # 2: one representative of each context is refined
    placed = docs.select(key.alias("_sd_k"), F.col(f"`{text_col}`").alias("_sd_text"),
                         *[F.col(f"`{c}`").alias(f"_sd_c{i}") for i, c in enumerate(keep)])
    wanted = contexts.groupBy(F.col("k").alias("_k")).agg(
        F.collect_list(F.struct("gram", "context")).alias("wanted"))
    names = [f"_sd_c{i}" for i in range(len(keep))]
    # rows with one id and text are one source here: such contexts have times > 1 anyway
    texts = saved(short.join(wanted, F.col("k") == F.col("_k")).select("_sd_text", "wanted")
                  .mapInArrow(_contexts(length), "gram long, context long, anchor int, text binary"),
                  "repeats-texts")
    block = ["gram", "context"]
    places = repeated_windows(texts, length).groupBy(*block).agg(
        F.collect_set(F.struct("place", "many")).alias("places")) \
        .join(contexts.filter("times = 1").select(*block), block, "left_semi")
    none = F.lit(None).cast("array<struct<place:int,many:int>>").alias("places")     # all windows
    status = saved(places.unionByName(contexts.filter("times > 1").select(*block, none)).select(
        F.col("gram").alias("_g"), F.col("context").alias("_c"), "places"), "repeats-status")
    spans = active.filter("one").select("k", "s", "n", none).unionByName(
        active.filter("not one").join(status, (F.col("gram") == F.col("_g")) & (F.col("context") == F.col("_c")))
        .select("k", "s", "n", "places"))
    per_doc = spans.groupBy(F.col("k").alias("_k")).agg(
        F.collect_list(F.struct("s", "n", "places")).alias("spans"))
    types = [docs.schema[c].dataType for c in keep]
    out = T.StructType([*[T.StructField(f"c{i}", t) for i, t in enumerate(types)],
                        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                        T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    got = placed.join(per_doc, F.col("_sd_k") == F.col("_k"), "left") \
        .select("_sd_k", "_sd_text", *names, "spans") \
        .mapInArrow(_cut(length, names, as_text), out)
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed",
                      "n_spans", "kept_sha256", "kept")


def without_repeats(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with the repeated passages cut from the text (all rows stay)."""
    text = kw.get("text_col", "text")
    got = remove_repeats(docs, keep=docs.columns, as_text=True, **kw)
    cut = F.when(F.col(f"`{text}`").isNotNull(), F.col("_sd_kept"))
    got = got.toDF(*docs.columns, "_sd_bytes", "_sd_removed", "_sd_spans", "_sd_sha", "_sd_kept")
    return got.select(*[(cut if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
