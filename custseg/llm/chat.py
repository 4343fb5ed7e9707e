"""Chat formatting as a prefix tree.

Template of a turn: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``.  Inside role
and text a backslash becomes ``\\s`` and ``<|`` becomes ``<\\b`` (and a line
feed in a role ``\\n``), so no control string can come from a text and the
escape is undone exactly.

Tree.  Conversations that start with the same turns share those nodes.  The
conversations are range-partitioned and sorted by the sequence of their turns'
hashes; in that order a conversation adds exactly the turns after the prefix
that it shares with the conversation before it, and emitting those turns walks
the tree depth-first.  Identical conversations are split by their id, so a very
common one does not fill one partition.  Inside a partition the shared prefix
comes from the previous row; at a partition's edge from a summary row per
partition (first and last path), resolved in order.  Each shared turn is thus
emitted once in the whole output, and the only thing that meets in one place is
one summary per partition.

Output.  ``nodes``: the emitted stream, one row per node with its place in the
stream (``start``, ``size``; a token is a code point), the position id of its
first token (tokens of its ancestors), the loss interval inside its text
(assistant texts) and the stream intervals its tokens attend to besides
themselves (its ancestors, merged where adjacent).  ``paths``: per conversation
the starts of its nodes.

Cases: null role or text is empty; turns sort by turn (null first), then role,
then text; rows alike stay separate turns; null conv_id is a conversation of
its own; an empty table gives empty outputs.  A conversation is one row of work,
as its digest is sequential anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import saved

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
FLUSH = 4 << 20

_WALK = ("kind string, part int, conv_id long, start long, size long, position long, text string, "
         "loss_start long, loss_end long, lists array<array<long>>, digests array<string>")
_NAMES = ["kind", "part", "conv_id", "start", "size", "position", "text", "loss_start", "loss_end",
          "lists", "digests"]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
          pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]


def escape(s: str) -> str:
    return s.replace("\\", "\\s").replace("<|", "<\\b")


def escape_role(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def unescape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("<\\b"), F.lit("<|"))
    if role:
        c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


@dataclass
class Edge:
    """How a partition's own starts map to the whole stream: nodes under
    ``shift`` were emitted by earlier partitions, at ``known``."""
    shift: int
    offset: int
    own: list[int]
    known: list[int]

    def start(self, x: int) -> int:
        return self.known[self.own.index(x)] if x < self.shift else self.offset + x - self.shift

    def intervals(self, flat: list[int]) -> list[list[int]]:
        out: list[list[int]] = []

        def add(a, b):
            if out and out[-1][1] == a:
                out[-1][1] = b
            elif b > a:
                out.append([a, b])
        ends = [*self.own[1:], self.shift]
        for a, b in zip(flat[::2], flat[1::2]):
            for o, e, k in zip(self.own, ends, self.known):
                if a <= o and e <= b:
                    add(k, k + e - o)
            a = max(a, self.shift)
            if a < b:
                add(self.offset + a - self.shift, self.offset + b - self.shift)
        return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes, paths and a summary of one sorted partition, in its own stream."""
    part, end = TaskContext.get().partitionId(), 0
    prev: list[tuple[str, str]] = []
    starts: list[int] = []           # of the nodes of the current path
    sizes: list[int] = []
    rows, held = [], 0
    first = None

    def digests(turns):
        return [hashlib.md5(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).hexdigest() for r, t in turns]

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    for b in batches:
        for conv, listed in zip(b.column(0), b.column(1)):
            turns = [(t["role"] or "", t["text"] or "") for t in listed.as_py()]
            shared = 0
            while shared < min(len(prev), len(turns)) and prev[shared] == turns[shared]:
                shared += 1
            del starts[shared:], sizes[shared:]
            spans: list[int] = []    # of the ancestors, merged
            position = 0
            for s, n in zip(starts, sizes):
                position += n
                if spans and spans[-1] == s:
                    spans[-1] = s + n
                else:
                    spans += [s, s + n]
            for role, text in turns[shared:]:
                head, body = HEAD + escape_role(role) + "\n", escape(text)
                size = len(head) + len(body) + len(TAIL)
                loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
                rows.append(("node", part, None, end, size, position, head + body + TAIL, *loss,
                             [list(spans)], None))
                held += size + 8 * len(spans)
                if spans and spans[-1] == end:
                    spans[-1] = end + size
                else:
                    spans += [end, end + size]
                starts.append(end)
                sizes.append(size)
                position += size
                end += size
                if held > FLUSH:
                    yield flush()
                    rows, held = [], 0
            rows.append(("path", part, conv.as_py(), None, None, None, None, None, None, [list(starts)], None))
            held += 8 * len(starts) + 64
            if first is None:
                first = (digests(turns), list(starts), list(sizes))
            prev = turns
            if held > FLUSH:
                yield flush()
                rows, held = [], 0
    if first is not None:
        rows.append(("edge", part, None, None, end, None, None, None, None,
                     [first[1], first[2], list(starts)], None))
        rows.append(("first", part, None, None, None, None, None, None, None, None, first[0]))
        rows.append(("last", part, None, None, None, None, None, None, None, None, digests(prev)))
        yield flush()


def _edges(walked: DataFrame) -> dict[int, Edge]:
    """Resolve the partitions' summaries in order (three rows per partition)."""
    got = walked.filter(F.col("kind").isin("edge", "first", "last")) \
        .select("kind", "part", "size", "lists", "digests").collect()
    by: dict[int, dict] = {}
    for r in got:
        by.setdefault(r["part"], {})[r["kind"]] = r
    out: dict[int, Edge] = {}
    offset, last, known = 0, [], []
    for part in sorted(by):
        edge = by[part]["edge"]
        own, sizes, final = edge["lists"]
        head = by[part]["first"]["digests"]
        n = 0
        while n < min(len(last), len(head)) and last[n] == head[n]:
            n += 1
        e = out[part] = Edge(sum(sizes[:n]), offset, own[:n], known[:n])
        offset += edge["size"] - e.shift
        last, known = by[part]["last"]["digests"], [e.start(x) for x in final]
    return out


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``paths`` of rows (conversation, turn, role, text)."""
    convs = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    hashed = saved(convs, "chat-conversations").withColumn(
        "_path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    order = ["_path", "conv_id"]
    walked = saved(hashed.repartitionByRange(*order).sortWithinPartitions(*order)
                   .select("conv_id", F.transform("turns", lambda t: F.struct(
                       t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
                   .mapInArrow(_walk, _WALK), "chat-walk")
    edges = _edges(walked)

    def place_nodes(batches):
        for b in batches:
            part, start = b.column("part").to_pylist(), b.column("start").to_pylist()
            spans = b.column("lists").to_pylist()
            keep = [i for i in range(b.num_rows) if start[i] >= edges[part[i]].shift]
            t = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([edges[part[i]].start(start[i]) for i in keep], pa.int64()),
                 t.column("size"), t.column("position"), t.column("text"), t.column("loss_start"),
                 t.column("loss_end"),
                 pa.array([edges[part[i]].intervals(spans[i][0]) for i in keep],
                          pa.list_(pa.list_(pa.int64())))],
                names=["start", "size", "position", "text", "loss_start", "loss_end", "attend"])

    def place_paths(batches):
        for b in batches:
            part, lists = b.column("part").to_pylist(), b.column("lists").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"),
                 pa.array([[edges[p].start(x) for x in s[0]] for p, s in zip(part, lists)],
                          pa.list_(pa.int64()))], names=["conv_id", "starts"])

    nodes = walked.filter("kind = 'node'") \
        .select("part", "start", "size", "position", "text", "loss_start", "loss_end", "lists") \
        .mapInArrow(place_nodes, "start long, size long, position long, text string, loss_start long, "
                                 "loss_end long, attend array<array<long>>")
    paths = walked.filter("kind = 'path'").select("part", "conv_id", "lists") \
        .mapInArrow(place_paths, "conv_id long, starts array<long>")
    return saved(nodes, "chat-nodes"), saved(paths, "chat-paths")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``conv_id, parts``: per conversation its (role, text, loss, formatted) turns,
    parsed from the emitted nodes."""
    steps = paths.select("conv_id", F.posexplode("starts").alias("i", "start"))
    t = steps.join(nodes.select("start", "text", "loss_start", "loss_end"), "start")
    rest = F.substr("text", F.lit(len(HEAD) + 1))
    role = F.substring_index(rest, "\n", 1)
    body = F.substr(rest, F.length(role) + 2, F.length(rest) - F.length(role) - 1 - len(TAIL))
    loss = F.substr("text", (F.col("loss_start") + 1).cast("int"),
                    (F.col("loss_end") - F.col("loss_start")).cast("int"))
    parsed = t.select("conv_id", F.struct(
        "i", unescape(role, True).alias("role"), unescape(body).alias("text"),
        unescape(loss).alias("loss"), F.length("text").alias("chars")).alias("t"))
    return parsed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("parts"))


def digests(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.array_join(F.transform("parts", lambda p: F.concat(
        p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    chars = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["chars"])
    return read_back(nodes, paths).select(
        "conv_id", F.size("parts").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        chars.alias("formatted_chars"))
