"""Repair of conversation structure by depth-first branch-and-bound.

Faults.  Rows of a conversation stand by turn (null first), then role, then text.
The first of these that holds is a row's fault: *blank* (no character but space
and ``\\t``-``\\r``), *duplicate* (role and text were seen earlier in the
conversation), *truncated* (its last such character is none of ``.!?``).

Repair.  The cheapest edits that make the initials of the roles read
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete (3, the only
choice for a blank or duplicate row), Insert an empty user or assistant row
anywhere (2); a truncated row that stays costs 1.  The audit is the edits'
initials in order; of equally cheap audits the least in ASCII wins.

Search.  A node is (rows consumed, state), the state being what the emitted
roles allow next (0 nothing yet, 1 after s, 2 after u, 3 after a).  An explicit
stack holds prefixes (cost, audit), the promising child on top.  A prefix is cut
when its cost plus the *suffix lower bound* exceeds the incumbent, or equals it
with a greater audit, and when the *dominance table* of its node holds a
prefix that is no worse; both cuts are exact, as audits of one node are never
prefixes of each other at one cost.  When the stack is empty the incumbent
(cost, audit) is proved optimal.  The bound adds what every row must cost by
itself and 2 for each disjoint pair of neighbours that cannot stand together.

Spark.  Rows are range-partitioned by (conversation, turn, role, text, number),
so a conversation of any length -- and even a row repeated without end -- is
split; a conversation that stays whole is one block, a longer one becomes
blocks of ``BLOCK`` rows.  Blocks are searched in parallel, for each entry and
exit state where there are several, and a fold over a conversation's blocks (a
record of a few audits per ``BLOCK`` rows) joins them.  Search results are kept
per pattern of rows, so that common shapes are searched once per worker.  An audit
is one string, hence one task joins a conversation's audit.

Output.  ``plans``: a row per conversation (counts, cost, audit); ``rows``: the
repaired rows (conv_id, place, edit, role, text), deleted ones left out.

Cases: null role or text is one space; a null turn sorts first, rows alike count
as repeats; null conv_id is a conversation of its own; roles with other
initials can only be reroled or deleted; very long texts and conversations are
used whole; a conversation without rows is not in the output; an empty table gives
empty outputs.  Only the four columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import NO_ID, id_of, saved

# fixed values of the repair: costs of the edits and of a truncated row that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

BLOCK = 128                 # rows searched at once in a conversation that is split
_ROW_BITS = 33              # layout of monotonically_increasing_id
_SOLID = r"[^\x20\x09-\x0D]"
_LAST = r"[.!?][\x20\x09-\x0D]*\z"

ACCEPT = (0, 3)
STATES = (0, 1, 2, 3)
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_SEEN = {0: "^", 1: "s", 2: "u", 3: "a"}
_LEGAL = {"su", "ua", "au"}
_NEXT = {"^s", "^u", *_LEGAL}
_ROLE = {2: "user", 3: "assistant"}


# ------------------------------------------------------------------------ search
def initial(code: str) -> str:
    """Role initial of a row's code: s, u, a or x; upper case truncated, digits faulty."""
    return "suax"[int(code)] if code.isdigit() else code.lower()


@lru_cache(maxsize=1 << 12)
def bounds(codes: str, tail: bool) -> dict[str, list[int]]:
    """``bounds[seen][i]``: least cost of rows i.. after an emitted ``seen`` (^ nothing, * unknown)."""
    n = len(codes)
    out = {seen: [0] * (n + 1) for seen in "^sua*"}
    for seen in "^sua*":
        out[seen][n] = INSERT if tail and seen in "su" else 0
    for i in range(n - 1, -1, -1):
        c = codes[i]
        role, own = initial(c), TRUNCATED if c.isupper() else 0
        for seen in "^sua*":
            if c.isdigit():
                out[seen][i] = DELETE + out[seen][i + 1]
            elif role == "x":
                out[seen][i] = REROLE + own + out["*"][i + 1]
            elif seen != "*" and seen + role not in _NEXT:
                out[seen][i] = REROLE + own + out["*"][i + 1]
            else:
                out[seen][i] = own + out[role][i + 1]
    return out


@lru_cache(maxsize=1 << 15)
def search(codes: str, state: int, goals: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """The least (cost, audit) from ``state`` through all rows into one of
    ``goals``; without ``tail`` nothing is inserted after the last row."""
    n, low = len(codes), bounds(codes, tail)
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, state)]
    while stack:
        cost, audit, i, q = stack.pop()
        if best is not None:
            reach = cost + low[_SEEN[q]][i]
            if reach > best[0] or (reach == best[0] and audit > best[1][:len(audit)]):
                continue
        held = table.get((i, q))
        if held is not None and held <= (cost, audit):
            continue
        table[i, q] = (cost, audit)
        if i == n:
            if q in goals and (best is None or (cost, audit) < best):
                best = (cost, audit)
            if not tail:
                continue
        kids = []
        if i < n:
            c = codes[i]
            kids.append((cost + DELETE, audit + "D", i + 1, q))
            if not c.isdigit():
                own = TRUNCATED if c.isupper() else 0
                kept = _AFTER.get((q, initial(c)))
                if kept is not None:
                    kids.append((cost + KEEP + own, audit + "K", i + 1, kept))
                kids.append((cost + REROLE + own, audit + "R", i + 1, 3 if q == 2 else 2))
        kids.append((cost + INSERT, audit + "I", i, 3 if q == 2 else 2))
        kids.sort(key=lambda k: (k[0] + low[_SEEN[k[3]]][k[2]], k[1]), reverse=True)
        stack += kids
    return best


def illegal_pairs(codes: str, before: str = "") -> int:
    roles = [initial(c) for c in before[-1:] + codes]
    return sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))


# ------------------------------------------------------------------------- Spark
def laid_out(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with their layout ``_p, _i`` in (conversation, turn, role, text) order,
    ``_h`` (digest of role and text) and the code of initial and own fault."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" "))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" "))
    order = ["_c", "turn", "role", "text", "_n"]
    rows = turns.select(F.coalesce(F.col(f"`{conv_col}`").cast("long"), F.lit(NO_ID)).alias("_c"),
                        F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        F.monotonically_increasing_id().alias("_n"))
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order) \
        .withColumn("_id", F.monotonically_increasing_id())
    first = F.substring("role", 1, 1)
    known = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    blank = ~F.col("text").rlike(_SOLID)
    code = F.when(blank, F.translate(known, "suax", "0123")) \
        .when(F.col("text").rlike(_LAST), known).otherwise(F.upper(known))
    return laid.select(
        "_c", "turn", "role", "text", F.shiftright("_id", _ROW_BITS).alias("_p"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_i"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("_h"),
        code.alias("_code"), blank.alias("_blank"))


def blocks_of(laid: DataFrame) -> DataFrame:
    """``_c, _p, _b, codes, kept counts``: the rows of a block as one pattern."""
    place = F.struct("_p", "_i")
    slim = laid.select("_c", "_h", "_p", "_i", "_code", "_blank")
    # only what occurs again travels: one row per repeated (conversation, role, text)
    again = slim.groupBy("_c", "_h").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_k")) \
        .filter("_k > 1").select(F.col("_c").alias("_c2"), F.col("_h").alias("_h2"), "_first")
    marked = slim.join(again, (F.col("_c") == F.col("_c2")) & (F.col("_h") == F.col("_h2")), "left")
    later = F.coalesce(place > F.col("_first"), F.lit(False)) & ~F.col("_blank")
    code = F.when(later, F.translate(F.lower("_code"), "suax", "0123")).otherwise(F.col("_code"))
    got = marked.select("_c", "_p", (F.col("_i") / BLOCK).cast("long").alias("_b"), "_i", code.alias("_code"),
                        "_blank", later.alias("_later"))
    return got.groupBy("_c", "_p", "_b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_code"))), lambda r: r["_code"]),
                     "").alias("codes"),
        F.count_if("_blank").alias("blank"), F.count_if("_later").alias("duplicate"))


_SOLVED = "_c long, _p long, _b long, _state int, audit string, cost long, illegal long"


def _solo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(search(c, 0, ACCEPT, True), illegal_pairs(c)) for c in b.column("codes").to_pylist()]
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column("_c"), b.column("_p"), b.column("_b"), pa.array([0] * n, pa.int32()),
             pa.array([r[0][1] for r in out], pa.string()), pa.array([r[0][0] for r in out], pa.int64()),
             pa.array([r[1] for r in out], pa.int64())],
            names=["_c", "_p", "_b", "_state", "audit", "cost", "illegal"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least (cost, audit) of each block for every entry and exit state, and at
    the conversation's end (exit -1)."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for b in batches:
        found = []
        for codes in b.column("codes").to_pylist():
            row = []
            for a in STATES:
                for z, goals, tail in [*((z, (z,), False) for z in STATES), (-1, ACCEPT, True)]:
                    got = search(codes, a, goals, tail)
                    if got:
                        row.append({"a": a, "z": z, "cost": got[0], "audit": got[1]})
            found.append(row)
        yield pa.RecordBatch.from_arrays(
            [b.column("_c"), b.column("_p"), b.column("_b"), b.column("codes"), pa.array(found, kind)],
            names=["_c", "_p", "_b", "codes", "steps"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the blocks of a conversation, which come in order.

    Per state the frontier holds (cost, rank): ranks order the audits so far, so
    only a block's own audits are ever compared.  A step back leads to the choice
    in the block before."""
    names = [f.split()[0] for f in _SOLVED.split(", ")]
    conv, frontier, held, back, last, wrong = None, {0: (0, 0)}, [], [], "", 0

    def best(entries, end):
        options: dict[int, tuple] = {}
        for s in entries:
            if (s["z"] == -1) != end or s["a"] not in frontier:
                continue
            cost, rank = frontier[s["a"]]
            option = (cost + s["cost"], rank, s["audit"], s["a"])
            if s["z"] not in options or option < options[s["z"]]:
                options[s["z"]] = option
        return options

    def close():
        total, _, audit, a = best(held[-1][2], True)[-1]
        rows = [(conv, *held[-1][:2], a, audit, total, wrong)]
        for (p, b, _), choice in zip(held[-2::-1], back[::-1]):
            _, _, audit, a2 = choice[a]
            a = a2
            rows.append((conv, p, b, a, audit, 0, 0))
        rows.reverse()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(),
                                                         pa.int64(), pa.int64()))], names=names)
    for batch in batches:
        for c, p, b, codes, entries in zip(*(batch.column(k).to_pylist() for k in ("_c", "_p", "_b", "codes", "steps"))):
            if c != conv:
                if held:
                    yield close()
                conv, frontier, held, back, last, wrong = c, {0: (0, 0)}, [], [], "", 0
            elif held:
                options = best(held[-1][2], False)
                held[-1] = (*held[-1][:2], None)
                order = sorted(options, key=lambda z: options[z][1:3])
                frontier = {z: (options[z][0], order.index(z)) for z in options}
                back.append(options)
            held.append((p, b, entries))
            wrong += illegal_pairs(codes, last)
            last = codes[-1]
    if held:
        yield close()


def solved(blocks: DataFrame) -> DataFrame:
    """``_c, _p, _b, _state, audit, cost, illegal`` of every block: its part of the
    audit from its entry state; cost and illegal of the whole in the last block."""
    split = blocks.groupBy("_c").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_c")
    solo = blocks.join(split, "_c", "left_anti").select("_c", "_p", "_b", "codes").mapInArrow(_solo, _SOLVED)
    steps = blocks.join(split, "_c", "left_semi").select("_c", "_p", "_b", "codes").mapInArrow(
        _steps, "_c long, _p long, _b long, codes string, "
                "steps array<struct<a:int,z:int,cost:bigint,audit:string>>")
    folded = steps.repartition("_c").sortWithinPartitions("_c", "_p", "_b").mapInArrow(_fold, _SOLVED)
    return solo.unionByName(folded)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of a block from its rows, its entry state and its audit."""
    kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    for b in batches:
        found = []
        for state, audit, rows in zip(*(b.column(k).to_pylist() for k in ("_state", "audit", "rows"))):
            q, at, out = state, 0, []
            for edit in audit:
                if edit == "I":
                    q = 3 if q == 2 else 2
                    out.append({"edit": edit, "role": _ROLE[q], "text": ""})
                    continue
                row, at = rows[at], at + 1
                if edit == "R":
                    q = 3 if q == 2 else 2
                    out.append({"edit": edit, "role": _ROLE[q], "text": row["text"]})
                elif edit == "K":
                    q = _AFTER[q, row["role"][0]]
                    out.append({"edit": edit, "role": row["role"], "text": row["text"]})
            found.append(out)
        yield pa.RecordBatch.from_arrays([b.column("_c"), b.column("_p"), b.column("_b"), pa.array(found, kind)],
                                         names=["_c", "_p", "_b", "rows"])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``plans`` (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and
    ``rows`` (conv_id, place, rows: the repaired rows of a block; place orders the blocks)."""
    laid = saved(laid_out(turns, conv_col, turn_col, role_col, text_col), "repair-rows")
    blocks = saved(blocks_of(laid), "repair-blocks")
    parts = saved(solved(blocks), "repair-audits")
    counts = blocks.groupBy("_c").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum(F.length(F.regexp_replace("codes", "[^SUAX]", ""))).cast("long").alias("truncated"))
    gaps = laid.groupBy("_c").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audits = parts.groupBy("_c").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_b", "audit"))),
                                 lambda r: r["audit"]), "").alias("audit"))
    plans = gaps.join(counts, "_c").join(audits, "_c").select(
        id_of("_c").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    texts = laid.groupBy("_c", "_p", (F.col("_i") / BLOCK).cast("long").alias("_b")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "role", "text"))),
                    lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))
    done = texts.join(parts.select("_c", "_p", "_b", "_state", "audit"), ["_c", "_p", "_b"]) \
        .mapInArrow(_edited, "_c long, _p long, _b long, rows array<struct<edit:string,role:string,text:string>>")
    rows = done.select(id_of("_c").alias("conv_id"), F.struct("_p", "_b").alias("place"), "rows")
    return plans, rows


def digest(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of the lines ``role:text``.  A digest reads its
    conversation in order, so this step has one row per conversation."""
    lines = F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "_lines"))), lambda b: b["_lines"]))
    return rows.select("conv_id", "place", lines.alias("_lines")).groupBy("conv_id").agg(
        F.sha2(F.array_join(whole, "\n"), 256).alias("repaired_sha256"))


def crc(*parts: Column) -> Column:
    """crc32 of the parts as text, joined by colons; a null part is one space."""
    return F.crc32(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit(" ")) for p in parts]).cast("binary"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by ``crc32(conv_id:turn) % 20``: 0
    drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets
    the role user.  Null role and text become one space first."""
    kind = crc(F.col("conv_id"), F.col("turn")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
        kind.alias("_kind"))
    return rows.filter("_kind != 0").drop("_kind", "_copy")
