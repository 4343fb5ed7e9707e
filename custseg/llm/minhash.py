"""Near-duplicate documents by order MinHash.

Shingles are ``SHINGLE`` words (runs of bytes other than ASCII white space; a
text of fewer words is one shingle).  The i-th occurrence of a shingle in a
text is labelled i, so repeats count.  One sketch takes the ``PICK`` labelled
shingles of least hash *in text order*: two texts share it when they share
those shingles and their order, so the sketch follows edit similarity.
``TABLES`` sketches per text; at similarity s one is shared with about s**3, so
at 0.8 all sixteen miss with probability 1e-5.

Candidates.  Exact copies are one class (``xxhash64`` of the text) with one
representative.  A bucket is the texts that share a sketch.  First each member
is paired with the leader of its bucket and of its sub-bucket (those that share
the next two sketches too); the leader is the text that meets most others, as
an original does among its copies.  So a bucket of n texts gives at most 2n
pairs, and no bucket is capped.  Links inside one component need no further
look.  Where a bucket still holds several components, every text outside its
largest component (a stray) meets every member of the other components, so no
two texts that share a sketch stay unlinked without a look.  These meetings are
blocks of rows in a task, not rows of their own: a pair is looked at under the
first sketch it shares, and only goes on to verification if its lengths and the
shingle counts of both texts by ``CLASSES`` hash classes allow the similarity.
Both are exact bounds (the sum of the lesser counts is at least what the texts
share), so nothing is lost by them.  The meetings are of all pairs of different
components at once, hence a second round would have nothing new to look at.
In a bucket of n texts with m strays they take n * m steps.  Recall is
measured against brute force in the tests.

Verification.  Both texts' labelled shingles are aligned: the longest common
subsequence within the band that a similarity of ``SIMILARITY`` allows (labels
match at most once, so it is a longest increasing run of matched places).  With
M aligned shingles of A and B, the texts are linked if M / (A + B - M) >=
``SIMILARITY``: the Jaccard similarity of the labelled shingles, less what is
out of order.  A representative's members are verified next to it in groups of
at most about ``GROUP``, so a text with very many copies is many groups.

Classes are the connected components of the verified links.

Cases: null and empty texts are copies of each other; rows alike are copies;
a null id counts as the least id and stays null; texts of any length are used
whole; an empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import id_of, keyed, mix64, runs_of, saved, seeds, utf8, word_hashes
from custseg.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 16
PICK = 3
GROUP = 256
BLOCK, PROBES = 256, 1024                 # strays and members that meet at once
CLASSES = 512                             # hash classes of the shingle counts
PAIRS = 4096                              # pairs of counts compared at once
_PLACE = 28                               # bits of a word's place beside its hash

U = np.uint64
_SEEDS = seeds(TABLES + 8, 5)


def shingle_labels(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of the rows, end to end, and their offsets."""
    words, at = word_hashes(data, off)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = at[row] + np.arange(out[-1]) - out[row]
    h = np.full(len(row), U(0x51ED270B35A1))
    for i in range(k):
        p = first + i
        inside = p < at[row + 1]
        w = words[np.minimum(p, max(len(words) - 1, 0))] if len(words) else words
        h = mix64(h * _SEEDS[-1] + np.where(inside, w, U(0)) + inside.astype(U))
    # number the equal shingles of a row in text order
    order = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    if len(h):
        hs, rs = h[order], row[order]
        same[1:] = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
    place = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(same, 0, place)) if len(h) else place
    times = np.zeros(len(h), U)
    times[order] = (place - begin).astype(U)
    return mix64(h + times * _SEEDS[-2]), out


def sketches(labels: np.ndarray, off: np.ndarray, tables: int = TABLES, pick: int = PICK) -> np.ndarray:
    """Rows with at least one shingle: a row of ``tables`` sketches each."""
    start = off[:-1]
    place = (np.arange(len(labels)) - np.repeat(start, np.diff(off))).astype(U)
    low, top = U((1 << _PLACE) - 1), U(0xFFFFFFFFFFFFFFFF)
    place &= low
    out = np.empty((len(start), tables), U)
    for t in range(tables):
        h = labels * _SEEDS[t]
        h ^= h >> U(31)
        h *= U(0xBF58476D1CE4E5B9)
        h &= ~low
        h |= place
        got = np.empty((len(start), pick), U)
        for r in range(pick):
            least = np.minimum.reduceat(h, start)
            got[:, r] = np.where(least == top, top, least & low)
            h[start + np.minimum(least & low, (np.diff(off) - 1).astype(U)).astype(np.int64)] = top
        got.sort(axis=1)
        x = np.full(len(start), _SEEDS[t])
        for r in range(pick):
            at = np.where(got[:, r] == top, U(0), got[:, r]).astype(np.int64)
            x = mix64(x * _SEEDS[-3] + np.where(got[:, r] == top, U(r + 1), labels[start + at]))
        out[:, t] = x
    return out


def class_counts(labels: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Shingles of each row by ``CLASSES`` hash classes, in the least unsigned type that holds them."""
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    count = np.bincount(row * CLASSES + (labels % U(CLASSES)).astype(np.int64), minlength=rows * CLASSES)
    count = count.reshape(rows, CLASSES)
    most = count.max(1, initial=0)
    return [c.astype(np.uint8 if m < 1 << 8 else np.uint16 if m < 1 << 16 else np.uint32).tobytes()
            for c, m in zip(count, most)]


def _counts_of(column: list[bytes]) -> np.ndarray:
    """The rows of ``class_counts`` as one matrix."""
    if all(len(c) == CLASSES for c in column):
        return np.frombuffer(b"".join(column), np.uint8).reshape(-1, CLASSES)
    kinds = {CLASSES: np.uint8, 2 * CLASSES: np.uint16, 4 * CLASSES: np.uint32}
    return np.stack([np.frombuffer(c, kinds[len(c)]).astype(np.uint32) for c in column])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d, t = b.column(0).to_numpy(), b.column(1).to_numpy()
        data, off = utf8(b.column(2))
        for i, j in runs_of(off):
            labels, at = shingle_labels(data[off[i]:off[j]], off[i:j + 1] - off[i])
            n = np.diff(at)
            own = np.flatnonzero(n)
            flat = np.zeros(0, np.int64)
            if len(own):
                flat = sketches(labels, np.concatenate([at[:-1][own], at[-1:]])).view(np.int64).reshape(-1)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, TABLES, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[i:j]), pa.array(t[i:j]), pa.array(n.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array(class_counts(labels, at), pa.binary())], names=["_d", "_t", "n", "sketch", "counts"])


def aligned(places: np.ndarray, band: int) -> int:
    """Longest increasing run of ``places`` (the partner's place of the i-th own
    shingle, -1: none) with every place within ``band`` of i."""
    i = np.flatnonzero(places >= 0)
    p = places[i]
    p = p[np.abs(p - i) <= band]
    if len(p) < 2 or (np.diff(p) > 0).all():
        return len(p)
    tails: list[int] = []
    for x in p.tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, b_order: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Aligned similarity of labelled shingles ``a`` and ``b`` (``b_order`` sorts b)."""
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    need = int(np.ceil(threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9))
    bs = b[b_order]
    at = np.minimum(np.searchsorted(bs, a), len(b) - 1)
    places = np.where(bs[at] == a, b_order[at], -1)
    m = aligned(places, max(len(a), len(b)) - need)
    return m / (len(a) + len(b) - m)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rep, salt, member last): each member against its representative."""
    group, rep, order = None, None, None
    for b in batches:
        reps, salts, ts = (b.column(c).to_numpy() for c in ("rep", "salt", "t"))
        data, off = utf8(b.column("text"))
        out_a, out_b = [], []
        for i, j in runs_of(off):
            labels, at = shingle_labels(data[off[i]:off[j]], off[i:j + 1] - off[i])
            for r in range(i, j):
                own = labels[at[r - i]:at[r - i + 1]]
                if ts[r] == reps[r]:
                    group, rep = (reps[r], salts[r]), own.copy()
                    order = np.argsort(rep)
                elif (reps[r], salts[r]) == group and similarity(own, rep, order) >= SIMILARITY:
                    out_a.append(ts[r])
                    out_b.append(reps[r])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())],
                                         names=["a", "b"])


def _leader(t: str, weight: str):
    """The member of greatest weight; ties go by its low bits, the same way on every run."""
    return F.max_by(t, F.col(weight) * (1 << 24) + F.pmod(F.col(t), F.lit(1 << 24)))


def _fitting(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``t, rep`` with lengths that allow the similarity."""
    size = texts.select(F.col("_t").alias("_s"), "n")
    return pairs.distinct().join(size, F.col("t") == F.col("_s")).select("t", "rep", "n") \
        .join(size.select(F.col("_s").alias("_r"), F.col("n").alias("m")), F.col("rep") == F.col("_r")) \
        .filter(F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")).select("t", "rep")


def _buckets(texts: DataFrame) -> DataFrame:
    """``t, b, c, weight``: the buckets of at least two texts that a text is in, its
    sub-bucket, and how many texts it meets in all its buckets (an original meets
    more than its copies meet each other)."""
    nxt = lambda i, k: F.element_at("sketch", F.pmod(i + k, F.lit(TABLES)) + 1)
    rows = texts.select("_t", "sketch", F.posexplode("sketch").alias("i", "b")) \
        .select(F.col("_t").alias("t"), "b", F.xxhash64("b", nxt(F.col("i"), 1), nxt(F.col("i"), 2)).alias("c"))
    full = saved(rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                 .select(F.col("b").alias("_b"), "n"), "near-buckets")
    met = saved(rows.join(full, F.col("b") == F.col("_b")).select("t", "b", "c", "n"), "near-met")
    weight = met.groupBy(F.col("t").alias("_wt")).agg(F.sum("n").alias("weight"))
    return saved(met.join(weight, F.col("t") == F.col("_wt")).select("t", "b", "c", "weight"), "near-members")


def _stars(met: DataFrame) -> DataFrame:
    """Each member with the leader of its bucket and of its sub-bucket."""
    out = []
    for key in ("b", "c"):
        heads = saved(met.groupBy(F.col(key).alias("_k")).agg(_leader("t", "weight").alias("rep")),
                      "near-leaders")
        out.append(met.join(heads, F.col(key) == F.col("_k")).select("t", "rep"))
    return out[0].unionByName(out[1]).filter("t <> rep")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, block, part, probe): each probe with the strays of its group,
    left to those pairs whose similarity can reach ``SIMILARITY``."""
    held, names = None, None
    for b in batches:
        rows = pa.Table.from_batches([b])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        names = names or rows.schema.names
        bucket, block, part, probe, hub, t, l, n = (rows.column(c).to_numpy() for c in (
            "b", "block", "part", "probe", "hub", "t", "l", "n"))
        begin = np.ones(len(t), bool)
        begin[1:] = (np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(part) != 0)
        group = np.cumsum(begin) - 1
        first = np.flatnonzero(begin)
        strays = np.bincount(group[probe == 0], minlength=len(first))
        last = np.arange(first[-1], first[-1] + strays[-1])
        held = rows.take(pa.array(last))            # the group may go on in the next batch
        own = np.flatnonzero(probe == 1)
        many = strays[group[own]]
        ends = np.cumsum(many)
        if not len(own) or not ends[-1]:
            continue
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
        counts = _counts_of(rows.column("counts").to_pylist())
        out_t, out_r = [], []
        step = max(1, (1 << 18) // max(1, int(many.max())))
        for i in range(0, len(own), step):
            m = many[i:i + step]
            p = np.repeat(own[i:i + step], m)
            r = first[group[p]] + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
            ok = (l[p] != l[r]) & (hub[p] | (t[p] < t[r])) \
                & (np.minimum(n[p], n[r]) >= SIMILARITY * np.maximum(n[p], n[r]))
            p, r = p[ok], r[ok]
            if not len(p):
                continue
            at = (sketch[p] == sketch[r]).argmax(1)
            ok = sketch[p, at] == bucket[p]         # under the first sketch that they share
            p, r = p[ok], r[ok]
            for k in range(0, len(p), PAIRS):
                pk, rk = p[k:k + PAIRS], r[k:k + PAIRS]
                most = np.minimum(counts[pk], counts[rk]).sum(1, dtype=np.int64)
                ok = most >= SIMILARITY * (n[pk] + n[rk] - most) - 1e-6
                out_t.append(t[pk[ok]])
                out_r.append(t[rk[ok]])
        if out_t:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_t), pa.int64()),
                                              pa.array(np.concatenate(out_r), pa.int64())], names=["t", "rep"])


def _contested(texts: DataFrame, met: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs of different components that share a bucket and can be similar.

    Only buckets that still hold several components matter.  There the texts
    outside the largest component meet all members, in groups of about ``BLOCK``
    of the former and ``PROBES`` of the latter."""
    known = labels.select(F.col("node").alias("_node"), "label")
    rows = saved(met.join(known, F.col("t") == F.col("_node"), "left")
                 .select("t", "b", F.coalesce("label", "t").alias("l")), "near-labelled")
    count = rows.groupBy("b", "l").agg(F.count(F.lit(1)).alias("n"))
    split = saved(count.groupBy("b").agg(F.count(F.lit(1)).alias("of"), _leader("l", "n").alias("hub"),
                                         F.max("n").alias("most"), F.sum("n").alias("size")).filter("of > 1")
                  .select(F.col("b").alias("_b"), F.col("hub").alias("_hub"),
                          F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("blocks"),
                          F.ceil(F.col("size") / PROBES).cast("int").alias("parts")), "near-split")
    placed = saved(rows.join(split, F.col("b") == F.col("_b")).select(
        "t", "b", "l", (F.col("l") == F.col("_hub")).alias("hub"), "blocks", "parts"), "near-placed")
    wide = placed.join(texts.select("_t", "n", "sketch", "counts"), F.col("t") == F.col("_t")).drop("_t")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    block = F.pmod(F.xxhash64("t", "b"), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64("b", "t"), F.col("parts")).cast("int")
    place = lambda i, j, side: F.struct(
        i.alias("block"), j.alias("part"), F.lit(side).alias("probe"))
    to = F.transform(upto("blocks"), lambda i: place(i, part, 1))
    to = F.when(F.col("hub"), to).otherwise(F.concat(to, F.transform(upto("parts"), lambda j: place(block, j, 0))))
    dealt = wide.withColumn("to", F.explode(to)).select(
        "b", "to.block", "to.part", "to.probe", "hub", "t", "l", "n", "sketch", "counts")
    return dealt.repartition("b", "block", "part").sortWithinPartitions("b", "block", "part", "probe") \
        .mapInArrow(_meet, "t long, rep long")


def _verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``t, rep`` that are similar, as links ``a, b``."""
    pairs = saved(_fitting(pairs, texts), "near-pairs")
    # deal a representative's members into groups; its own text goes to each of them
    many = pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("rep").alias("_rep"), F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
    many = saved(many, "near-groups")
    members = pairs.join(many, F.col("rep") == F.col("_rep")).select(
        "t", "rep", F.pmod(F.xxhash64("t", "rep"), F.col("groups")).cast("int").alias("salt"))
    own = many.select(F.col("_rep").alias("t"), F.col("_rep").alias("rep"),
                      F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    wanted = members.unionByName(own).groupBy("t").agg(F.collect_list(F.struct("rep", "salt")).alias("to")) \
        .join(texts.select("_t", F.col("_d").alias("_rd")), F.col("t") == F.col("_t")) \
        .select(F.col("_t").alias("_rt"), "_rd", "to")
    wanted = saved(wanted, "near-wanted")
    # always by sorted shuffle, whatever the sizes: the plan is the same at every scale
    sent = docs.join(wanted.hint("merge"), (F.col("_t") == F.col("_rt")) & (F.col("_d") == F.col("_rd"))) \
        .select("_t", "_text", F.explode("to").alias("to")) \
        .select(F.col("to.rep").alias("rep"), F.col("to.salt").alias("salt"), F.col("_t").alias("t"),
                F.col("_text").alias("text"))
    order = ["rep", "salt", (F.col("t") != F.col("rep")).cast("int")]
    return saved(sent.repartition("rep", "salt").sortWithinPartitions(*order)
                 .mapInArrow(_verify, "a long, b long"), "near-links")


def near_links(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links ``a, b`` between distinct texts, and the components they make."""
    texts = saved(rows.groupBy("_t").agg(F.min("_d").alias("_d"), F.max("n").alias("n"),
                                         F.first("sketch").alias("sketch"),
                                         F.first("counts").alias("counts")), "near-texts")
    met = _buckets(texts)
    links = _verified(docs, texts, _stars(met))
    labels = components(links)
    more = _verified(docs, texts, _contested(texts, met, labels))
    links = links.unionByName(more).distinct()
    return links, components(links)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_d, _t, _cd, _ct, links`` per row: its key, the key of the row that stands for
    its class (least id, then least text hash) and the verified links of its text."""
    keys = keyed(docs, id_col, text_col)
    rows = saved(keys.mapInArrow(_sketch, "_d long, _t long, n long, sketch array<long>, counts binary"), "near-sketches")
    links, labels = near_links(keys, rows)
    labels = saved(labels.join(
        links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
        .agg(F.count(F.lit(1)).alias("links")), "node").withColumnRenamed("node", "_node"), "near-labels")
    named = saved(rows.select("_d", "_t").join(labels, F.col("_t") == F.col("_node"), "left")
                  .select("_d", "_t", F.coalesce("label", "_t").alias("_class"),
                          F.coalesce("links", F.lit(0)).alias("links")), "near-named")
    heads = saved(named.groupBy("_class").agg(F.min(F.struct("_d", "_t")).alias("_h"))
                  .select(F.col("_class").alias("_c"), F.col("_h._d").alias("_cd"), F.col("_h._t").alias("_ct")),
                  "near-heads")
    return named.join(heads, F.col("_class") == F.col("_c")).select("_d", "_t", "_cd", "_ct", "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of the class), links (verified links of its text
    to different texts), stays (whether the row stands for its class)."""
    return classes(docs, id_col, text_col).select(
        id_of("_d").alias("doc_id"), id_of("_cd").alias("class_id"), "links",
        ((F.col("_d") == F.col("_cd")) & (F.col("_t") == F.col("_ct"))).alias("stays"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class."""
    heads = classes(docs, id_col, text_col).filter((F.col("_d") == F.col("_cd")) & (F.col("_t") == F.col("_ct"))) \
        .select(F.col("_d").alias("_near_d"), F.col("_t").alias("_near_t")).distinct()
    heads = saved(heads, "near-stay")
    left = docs.withColumn("_near_ld", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))) \
        .withColumn("_near_lt", F.xxhash64(F.col(f"`{text_col}`")))
    return left.join(heads, (F.col("_near_ld") == F.col("_near_d")) & (F.col("_near_lt") == F.col("_near_t"))) \
        .dropDuplicates(["_near_ld", "_near_lt"]).select(*[F.col(f"`{c}`") for c in docs.columns])
