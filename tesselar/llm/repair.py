"""Repair of a conversation's structure: faults of its turns, and the cheapest edits that give a legal order of roles.

The roles of a repaired conversation begin with ``s?(ua)+`` or there are none. ``togo[i][state]`` is what the rest costs
from turn i on in a state of that grammar; it is filled backwards, then a forward walk takes, among the edits that keep to
the cheapest cost, the one whose initial is least in ASCII.

A conversation is met twice, both times in the order of its turns. First without texts: a turn is one byte, its faults were
found by the plan, repeated ones by aggregation on a digest of role and text. Then its texts stream past the audit, and
the hash takes them one by one. So a worker holds a few bytes for each turn of one conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, dropped, for_python, met_by_weight, stored

DELETE, INSERT, KEEP, REROLE = b"DIKR"
#: What edits cost, and what a truncated turn adds that is not deleted; fixed values.
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of the role that is due leads: a user's turn, but after one the assistant's.
NEXT = (USER, USER, ASSISTANT, USER)
#: A turn as one byte: its role's initial in the low bits (other: 0), faults above; GONE: dropped by the damage.
ROLES = {"s": 1, "u": 2, "a": 3}
BLANK, DUPLICATE, TRUNCATED, GONE = 4, 8, 16, 32
LEGAL = {(1, 2), (2, 3), (3, 2)}
FAR = 1 << 60


def _kept_to(role: int, state: int) -> int | None:
    """The state after a turn is kept as it is; None where its role is not due."""
    if role == 1:
        return SYSTEM if state == START else None
    return NEXT[state] if role == (2, 2, 3, 2)[state] else None


def _steps(flags: int, state: int) -> list[tuple[int, int, int]]:
    """(initial, cost, next state) of the edits that take one turn."""
    out = [(DELETE, COSTS[DELETE], state)]
    if not flags & (BLANK | DUPLICATE):
        more = TRUNCATED_COST if flags & TRUNCATED else 0
        to = _kept_to(flags & 3, state)
        if to is not None:
            out.append((KEEP, COSTS[KEEP] + more, to))
        out.append((REROLE, COSTS[REROLE] + more, NEXT[state]))
    return out


_STEPS = {(f, s): _steps(f, s) for f in range(32) for s in range(4)}


def _with_inserts(plain: list[int]) -> tuple[int, ...]:
    """Costs to go when turns may be inserted before the next one is taken; two in a row lead back to where they began."""
    user, assistant = min(plain[USER], COSTS[INSERT] + plain[ASSISTANT]), min(plain[ASSISTANT], COSTS[INSERT] + plain[USER])
    return min(plain[START], COSTS[INSERT] + user), min(plain[SYSTEM], COSTS[INSERT] + user), user, assistant


def cheapest(turns: bytes) -> tuple[int, bytes]:
    """The least cost, and the edits' initials that reach it, least in ASCII among all that do."""
    togo = [_with_inserts([0, FAR, FAR, 0])]
    for f in reversed(turns):
        after = togo[-1]
        togo.append(_with_inserts([min(c + after[to] for _, c, to in _STEPS[f, s]) for s in range(4)]))
    togo.reverse()
    audit, i, state = bytearray(), 0, START
    while i < len(turns) or togo[i][state]:
        left = togo[i][state]
        tight = [(INSERT, i, NEXT[state])] if COSTS[INSERT] + togo[i][NEXT[state]] == left else []
        if i < len(turns):
            tight += [(e, i + 1, to) for e, c, to in _STEPS[turns[i], state] if c + togo[i + 1][to] == left]
        edit, i, state = min(tight)
        audit.append(edit)
    return togo[0][START], bytes(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with ``gone, copy``, damaged by the hash of ``conv_id:turn``; null roles and texts are one space.

    0 drops the row (it stays with ``gone`` set, so that its conversation is known), 1 empties its text, 2 takes its
    ``[.!?]``, 3 repeats it, 4 makes it the user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", hit.alias("hit")).select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), F.explode(copies).alias("copy")
    )


def _flags(rows: DataFrame) -> DataFrame:
    """``rows`` with ``digest`` and ``flags``: the role and the first fault of each turn as one byte."""
    bare = F.btrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    role = F.lit(0)
    for letter, n in ROLES.items():
        role = F.when(initial == letter, n).otherwise(role)
    fault = F.when(F.col("gone"), GONE).when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(*".!?"), TRUNCATED).otherwise(0)
    return rows.select("*", F.unhex(F.substring(F.sha2(F.concat_ws("\0", "role", "text"), 256), 1, 32)).alias("digest"), (role + fault).cast("int").alias("flags"))


def _order(turn: str, digest: str) -> Column:
    """Orders a conversation's rows: by turn, nulls first; rows that share a turn by role and text, through their digest."""
    return F.struct(F.col(turn).isNotNull().alias("has"), F.coalesce(turn, F.lit(0)).alias("turn"), F.col(digest).alias("digest"), F.col("copy"))


def _by_conversation(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


PLANNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit binary"


def _planned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its turns in order."""
    made: list[tuple] = []
    turns, first, last, distinct = bytearray(), None, None, 0

    def done(conv: int | None) -> None:
        live = bytes(turns)
        count = [sum(1 for f in live if f & x) for x in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(live, live[1:], strict=False))
        made.append((conv, last - first + 1 - distinct if distinct else 0, *count, illegal, *cheapest(live)))

    def out() -> pa.RecordBatch:
        names = [x.split()[0] for x in PLANNED.split(", ")]
        columns = [pa.array(c, pa.binary() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*made, strict=True), strict=True)]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    open_, conv, before = False, None, None
    for c, turn, digest, copy, flags in _by_conversation(batches, ("conv_id", "turn", "digest", "copy", "flags")):
        if open_ and c != conv:
            done(conv)
            turns, first, last, distinct, before = bytearray(), None, None, 0, None
            if len(made) >= 5_000:
                yield out()
        open_, conv = True, c
        if flags & GONE:
            continue
        if (turn, digest, copy) == before and not flags & BLANK:  # a row that stands twice in the table
            flags = flags & 3 | DUPLICATE
        before = turn, digest, copy
        turns.append(flags)
        if turn is not None and turn != last:
            first, last, distinct = turn if first is None else first, turn, distinct + 1
    if open_:
        done(conv)
    if made:
        yield out()


HASHED = PLANNED.replace("audit binary", "audit string, repaired_sha256 string")


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans (``kind`` 0) with the hash of what the edits make of the turns that follow them."""
    names = [x.split()[0] for x in HASHED.split(", ")]
    plain = names[:7]
    made: list[tuple] = []
    plan, at, state, digest, empty = None, 0, START, hashlib.sha256(), True

    def add(turn: str) -> None:
        nonlocal empty
        digest.update(turn.encode() if empty else b"\n" + turn.encode())
        empty = False

    def due() -> str:
        nonlocal state
        state = NEXT[state]
        return "user" if state == USER else "assistant"

    def inserted() -> None:
        nonlocal at
        while at < len(plan[-1]) and plan[-1][at] == INSERT:
            add(due() + ":")
            at += 1

    def done() -> None:
        inserted()
        made.append((*plan[:-1], plan[-1].decode(), digest.hexdigest()))

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64() if n in plain else pa.string()) for n, c in zip(names, zip(*made, strict=True), strict=True)]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for kind, role, text, *own in _by_conversation(batches, ("kind", "role", "text", *plain, "audit")):
        if kind == 0:
            if plan is not None:
                done()
            if len(made) >= 5_000:
                yield out()
            plan, at, state, digest, empty = own, 0, START, hashlib.sha256(), True
            continue
        inserted()
        edit, at = plan[-1][at], at + 1
        if edit == KEEP:
            state = SYSTEM if role[:1] == "s" else NEXT[state]
            add(f"{role}:{text}")
        elif edit == REROLE:
            add(f"{due()}:{text}")
    if plan is not None:
        done()
    if made:
        yield out()


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of rows ``(conv_id, turn, role, text)``, after they were damaged (see ``damaged``):
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows without conv_id are one conversation; rows that share a turn come in the order of a digest of role and text, so
    the result does not depend on how the table is dealt. Null roles and texts are one space, hence a blank text. A row
    that comes again later, also a whole repeated turn, is a duplicate. A conversation all of whose rows are dropped has
    zeros, an empty audit and the hash of nothing. Texts may have any length; one turn lies in memory at a time, beside a
    few bytes for each turn of its conversation. An empty table gives an empty result; other columns are not read.
    """
    spark = conversations.sparkSession
    for_python(spark)
    ids = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    rows = _flags(damaged(ids))
    live = rows.filter(~F.col("gone")).select("conv_id", "digest", "turn", "copy")
    # The first of equal turns, partly aggregated in each task; only conversations that repeat themselves are looked up.
    found = live.groupBy("conv_id", "digest").agg(F.min(_order("turn", "digest")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = stored(found.select(F.col("conv_id").alias("c"), "digest", "first", "n"), "repeated_turns")
    total = rows.count()
    narrow = rows.select(F.col("conv_id"), F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), "turn", "digest", "copy", "flags", "gone")
    key = F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.col("c").isNull().alias("none"), "digest")
    keyed = repeats.select(key.alias("key"), "first", "n")
    met = met_by_weight(narrow.withColumn("key", F.struct("c", "none", "digest")), keyed, "key", "n", total)
    again = ~F.col("gone") & (F.col("flags").bitwiseAND(F.lit(BLANK)) == 0) & F.coalesce(_order("turn", "digest") > F.col("first"), F.lit(False))
    flags = F.when(again, F.col("flags").bitwiseAND(F.lit(3)) + DUPLICATE).otherwise(F.col("flags"))
    in_order = ["none", "c", F.col("turn").asc_nulls_first(), "digest", "copy"]
    plans = met.select("conv_id", "none", "c", "turn", "digest", "copy", flags.cast("int").alias("flags")).repartition("none", "c").sortWithinPartitions(*in_order).select("conv_id", "turn", "digest", "copy", "flags").mapInArrow(_planned, PLANNED)
    plans = stored(plans, "repair_plans")
    dropped(spark, repeats)

    names = [x.split()[0] for x in PLANNED.split(", ")]
    of = [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none")]
    nulls = lambda x: [F.lit(None).cast(t).alias(n) for n, t in x]
    heads = plans.select(*of, F.lit(0).alias("kind"), *nulls([("turn", "long"), ("digest", "binary"), ("copy", "int"), ("role", "string"), ("text", "string")]), *names)
    turns = rows.filter(~F.col("gone")).select(*of, F.lit(1).alias("kind"), "turn", "digest", "copy", "role", "text", "conv_id", *nulls([tuple(x.split()) for x in PLANNED.split(", ")[1:]]))
    together = heads.unionByName(turns).repartition("none", "c").sortWithinPartitions("none", "c", "kind", F.col("turn").asc_nulls_first(), "digest", "copy")
    return together.select("kind", "role", "text", *names).mapInArrow(_hashed, HASHED)
