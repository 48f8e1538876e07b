"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature is CHUNKS x WIDTH symbols of 16 bits, each from one MinHash. Two signatures that differ in at most
``RADIUS = CHUNKS * (ERRORS + 1) - 1`` symbols have, by the pigeonhole principle, a chunk with at most ``ERRORS``
differing symbols; every chunk is therefore indexed under each choice of ``ERRORS`` symbols left out, and all pairs within
the radius meet under some key. Pairs that meet and differ in at most ``ACCEPT`` symbols are confirmed on the full
shingle sets; with a similarity of 0.8, one pair in 30,000 never meets and one in a million differs in more.

A large group of alike texts is not expanded into all its pairs. Equal sets are one class from the start. Under a key, a
class within the radius of an earlier one follows it and is compared with it alone; a task lets its own classes follow
each other before anything is shuffled, so a key gathers leaders only. Where the members of a key are of several
components once these links are known, the key is looked at again: its largest component by blocks, each against the
members of the others, so no task holds a whole key. Nothing is dropped: whatever pair that meets is left uncompared lies
within one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, for_python, met_by_weight, stored, words
from .components import components

CHUNKS, WIDTH, ERRORS = 6, 4, 1
SYMBOLS = CHUNKS * WIDTH
#: Differing symbols up to which all pairs are found.
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Differing symbols up to which a pair that meets is confirmed; beyond it the sets differ by half.
ACCEPT = 16
#: Classes whose keys a task holds at once, and members of a key that a task looks at again at once.
WINDOW, BLOCK = 60_000, 1500
#: Members of a key up to which all that are alike enough are candidates of each other at once.
SMALL = 16
#: Ids of candidates that are broadcast at most (8 bytes each); more are met by a shuffle.
BROADCAST_IDS = 1_000_000
#: The choices of symbols of a chunk that a key leaves out.
LEFT_OUT = list(combinations(range(WIDTH), ERRORS))
#: Distinct words whose hashes a worker holds.
HELD_WORDS = 150_000
_draw = np.random.default_rng(20240229)
_MULTIPLY = _draw.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _draw.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_ODD = _draw.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole sequence is one where there are fewer words."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))
    n = min(size, len(ws))
    out = np.full(len(ws) - n + 1, len(ws) if n < size else size, np.uint64)
    for i in range(n):
        out += h[i : len(ws) - n + 1 + i] * _ODD[i % 64]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of symbols for each set; no set is empty."""
    every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for i in range(SYMBOLS):
        least = np.minimum.reduceat((every ^ _FLIP[i]) * _MULTIPLY[i], starts)
        out[:, i] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def _signed(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sets = [shingle_set(x, size) for x in b.column("text").to_pylist()]
            some = [x for x in sets if len(x)]
            made = iter(signatures(some)) if some else iter(())
            sigs = [next(made).tobytes() if len(x) else None for x in sets]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "digest": pa.array(digests, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    return run


def _sized(n: np.ndarray, m: int, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be alike enough at all."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _first_met(sig: np.ndarray, other: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the first under which each signature meets ``other``: a pair is handled there alone."""
    differ = (sig != other).reshape(-1, CHUNKS, WIDTH)
    few = differ.sum(2) <= ERRORS
    chunk = few.argmax(1)
    at = differ[np.arange(len(sig)), chunk]
    choice = np.full(len(sig), -1)
    for m in range(len(LEFT_OUT) - 1, -1, -1):
        rest = [i for i in range(WIDTH) if i not in LEFT_OUT[m]]
        choice[~at[:, rest].any(axis=1)] = m
    return chunk * len(LEFT_OUT) + choice == (key >> (16 * (WIDTH - ERRORS)))


#: A leader's row lies under its key. A follower's row names its leader and the key it was met under, and lies anywhere.
MEMBERS = "key long, id long, n long, sig binary, lead long, under long"


def _keys(sig: np.ndarray) -> np.ndarray:
    """Every key of every signature, by choice; a key holds its chunk, what it leaves out, and the remaining symbols."""
    parts, out = sig.reshape(-1, CHUNKS, WIDTH).astype(np.uint64), []
    for c in range(CHUNKS):
        for m, left_out in enumerate(LEFT_OUT):
            key = np.full(len(sig), c * len(LEFT_OUT) + m, np.uint64)
            for i in range(WIDTH):
                if i not in left_out:
                    key = (key << np.uint64(16)) | parts[:, c, i]
            out.append(key.view(np.int64))
    return np.stack(out) if out else np.zeros((0, 0), np.int64)


def _follow(n: np.ndarray, sig: np.ndarray, key: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Of the members of a key each leader, its followers, its candidates, and whether it has to be looked at again.

    Candidates are the followers that first meet it here, and in small groups others that are alike enough; in large groups
    these are left to the second look, which compares them only if their components still differ.
    """
    rest, small = np.arange(len(n)), len(n) <= SMALL
    while len(rest):
        lead, rest = rest[0], rest[1:]
        apart = (sig[rest] != sig[lead]).sum(1)
        alike = (apart <= ACCEPT) & _sized(n[rest], n[lead], percent)
        near = alike & (apart <= RADIUS)
        some = rest[alike if small else near]
        if len(some):
            some = some[_first_met(sig[some], sig[lead], key)]
        yield int(lead), rest[near], some, not small and bool((alike & ~near).any())
        rest = rest[~near]


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keyed(percent: int) -> Callable:
    """Rows of ``MEMBERS``: a task's classes under their keys, those that follow another of the task as its followers.

    A candidate of a leader that does not follow it is a row of its own, too, without a key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            ids, n, sig = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            raw = [x.tobytes() for x in sig]
            for keys in _keys(sig):
                by = np.lexsort((ids, keys))
                cuts = np.flatnonzero(np.diff(keys[by])) + 1
                starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(by)]])
                lone = by[starts[ends - starts == 1]]
                leads, led, b, of, under = [lone], [np.zeros(len(lone), bool)], [], [], []
                for x, y in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                    at = by[x:y]
                    key = int(keys[at[0]])
                    for lead, followers, some, again in _follow(n[at], sig[at], key, percent):
                        leads.append(at[[lead]])
                        led.append(np.array([len(followers) > 0 or again]))
                        met = np.isin(followers, some)
                        # A follower that was met under another key first is no candidate here, but a member all the same.
                        for who, to, when in ((followers[met], lead, key), (followers[~met], None, key), (np.setdiff1d(some, followers), lead, None), (np.array([lead] if len(followers) or again else [], int), None, key)):
                            b += ids[at[who]].tolist()
                            of += [None if to is None else int(ids[at[to]])] * len(who)
                            under += [when] * len(who)
                at, has = np.concatenate(leads), np.concatenate(led)
                m = len(b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys[at], np.array(b, np.int64) * np.int64(0x5DEECE66D1B) ^ np.arange(m)])), pa.array(np.concatenate([ids[at], np.array(b, np.int64)])),
                        pa.concat_arrays([pa.array(n[at]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array([raw[i] for i in at.tolist()], pa.binary()), pa.nulls(m, pa.binary())]),
                        pa.concat_arrays([pa.array(ids[at], pa.int64(), mask=~has), pa.array(of, pa.int64())]), pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(under, pa.int64())]),
                    ],
                    names=["key", "id", "n", "sig", "lead", "under"],
                )

        for b in batches:
            if b.num_rows:
                held.append((b.column("id").to_numpy(), b.column("n").to_numpy(), _signatures(b.column("sig"))))
            if sum(len(x[0]) for x in held) > WINDOW:
                yield from out()
        if held:
            yield from out()

    return run


def _groups(batches: Iterable[pa.RecordBatch], *extra: str, key: str = "key") -> Iterator[tuple]:
    """Keys with two members or more, from rows sorted by key: key, ids, sizes, signatures and other columns."""
    held: list[tuple] = []

    def whole(parts: list[tuple]) -> tuple:
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(len(parts[0])))

    def split(cols: tuple, last: bool) -> Iterator[tuple]:
        keys = cols[0]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        for a, e in zip(starts[: None if last else -1], ends[: None if last else -1], strict=True):
            if e - a > 1:
                yield int(keys[a]), *(c[a:e] for c in cols[1:])
        held[:] = [] if last else [tuple(c[starts[-1] :] for c in cols)]

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(x).to_numpy(zero_copy_only=False) for x in (key, "id", "n", *extra)]
        held.append((*cols[:3], _signatures(b.column("sig")), *cols[3:]))
        if held[0][0][0] != cols[0][-1]:
            yield from split(whole(held), False)
    if held:
        yield from split(whole(held), True)


def _pairs(rows: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
    """Rows (a, b, again): candidates, or (again) the class b under the key a whose members may need a second look."""
    a, b = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    again = np.concatenate([np.full(len(r[0]), r[2], bool) for r in rows])
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "again": pa.array(again)})


def _led(percent: int) -> Callable:
    """Candidates of each key against the classes that lead it, and the members of keys that somebody follows in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def leaders() -> Iterator[pa.RecordBatch]:
            """The batches without followers, whose rows are kept aside."""
            for b in batches:
                is_leader = pc.is_valid(b.column("sig"))
                others = b.filter(pc.invert(is_leader))
                numbers = lambda x: x.to_numpy(zero_copy_only=False)
                met, held = others.filter(pc.is_valid(others.column("lead"))), others.filter(pc.is_valid(others.column("under")))
                if met.num_rows:
                    rows.append((numbers(met.column("lead")), numbers(met.column("id")), False))
                if held.num_rows:
                    rows.append((numbers(held.column("under")), numbers(held.column("id")), True))
                yield b.filter(is_leader)

        for key, ids, n, sig, lead in _groups(leaders(), "lead"):
            led = bool((~np.isnan(lead.astype(float))).any())
            for i, followers, some, again in _follow(n, sig, key, percent):
                if len(some):
                    rows.append((np.full(len(some), ids[i]), ids[some], False))
                led |= again or len(followers) > 0 and len(ids) > 2
            if led:
                rows.append((np.full(len(ids), key), ids, True))
            if len(rows) > 2000:
                yield _pairs(rows)
                rows.clear()
        if rows:
            yield _pairs(rows)

    return run


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The cells of ``_groups``: each member's place, signature, component and side."""
    yield from _groups(batches, "component", "side", "key", key="cell")


def _open(i: int, rest: np.ndarray, n: np.ndarray, sig: np.ndarray, root: np.ndarray, side: np.ndarray, key: int, percent: int) -> np.ndarray:
    """Those of ``rest`` that member i has to be compared with: of another component, on the other side of the cell where it
    has two, alike enough by signature, and first met under this key."""
    rest = rest[(root[rest] != root[i]) & ((side[rest] != side[i]) | (side[i] == BOTH)) & _sized(n[rest], n[i], percent)]
    rest = rest[(sig[rest] != sig[i]).sum(1) <= ACCEPT]
    return rest[_first_met(sig[rest], sig[i], key)] if len(rest) else rest


#: Sides of a cell: its members are compared with those of the other side, or with each other.
LEFT, RIGHT, BOTH = 0, 1, 2


def _in_question(percent: int) -> Callable:
    """(cell, id) of the members of a cell that have somebody to be compared with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ids, n, sig, part, side, key in _across(batches):
            open_, every = np.zeros(len(ids), bool), np.arange(len(ids))
            for i in range(len(ids) - 1):
                some = _open(i, every[i + 1 :], n, sig, part, side, int(key[0]), percent)
                open_[some] = True
                open_[i] |= len(some) > 0
            if open_.any():
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.full(int(open_.sum()), cell)), "id": pa.array(ids[open_], pa.int64())})

    return run


def _joined(size: int, percent: int) -> Callable:
    """Confirmed links of each cell between components, until its members are of one component or all pairs are compared.

    Sets are compared where the members lie, so a cell gives fewer links than it has members, and no candidates.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, n, sig, part, side, key, text in _groups(batches, "component", "side", "key", "text", key="cell"):
            root, sets, a, b = part.copy(), {}, [], []

            def held(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingle_set(text[i], size)  # noqa: B023
                return sets[i]  # noqa: B023

            for i in range(len(ids) - 1):
                for j in _open(i, np.arange(i + 1, len(ids)), n, sig, root, side, int(key[0]), percent):
                    if root[j] == root[i]:
                        continue
                    both = len(np.intersect1d(held(i), held(j), assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        a.append(ids[i])
                        b.append(ids[j])
                        root[root == root[j]] = root[i]
                sets.pop(i, None)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _confirmed(size: int, percent: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, y, text_x, text_y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if x != last:  # rows come sorted by a
                    last, held = x, shingle_set(text_x, size)
                other = shingle_set(text_y, size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(other) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the named documents; few enough ids are broadcast, so that no other text is shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _cells(seen: DataFrame, heads: DataFrame, mixed: DataFrame) -> DataFrame:
    """The members of mixed keys, dealt to cells of about ``BLOCK`` members each side.

    ``mixed``: key, its largest component, and the numbers of blocks of that component (``k``) and of the others (``o``).
    Every block of the largest component meets every block of the others, and these meet each other.
    """
    seen = seen.join(mixed, "key").join(heads.select("id", "n", "sig"), "id")
    spread, main = F.xxhash64("id", "key"), F.col("component") == F.col("largest")
    at = F.when(main, F.pmod(spread, F.col("k"))).otherwise(F.pmod(spread, F.col("o")))
    many = lambda n, cell: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), cell)
    one = lambda left, x, y, side: F.struct(F.lit(left).alias("with_main"), x.cast("long").alias("x"), y.cast("long").alias("y"), side.cast("long").alias("side"))
    with_main = F.when(main, many("o", lambda j: one(True, F.col("at"), j, F.lit(LEFT)))).otherwise(many("k", lambda i: one(True, i, F.col("at"), F.lit(RIGHT))))
    others = many("o", lambda j: one(False, F.least(j, F.col("at")), F.greatest(j, F.col("at")), F.when(j == F.col("at"), BOTH).when(j < F.col("at"), RIGHT).otherwise(LEFT)))
    dealt = seen.withColumn("at", at).withColumn("c", F.explode(F.when(main, with_main).otherwise(F.concat(with_main, others))))
    return dealt.select(F.xxhash64("key", "c.with_main", "c.x", "c.y").alias("cell"), "key", "id", "n", "sig", "component", F.col("c.side").alias("side"))


def linked_classes(docs: DataFrame, heads: DataFrame, size: int, percent: int) -> DataFrame:
    """``(id, component)`` of all classes with a confirmed link; a class's id is the least id of its documents."""
    spark = docs.sparkSession
    members = heads.select("id", "n", "sig").mapInArrow(_keyed(percent), MEMBERS)
    met = stored(members.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_led(percent), "a long, b long, again boolean"), "pairs")
    pairs = stored(met.filter(~F.col("again")).select("a", "b").distinct(), "candidates")
    texts = stored(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "candidate_texts")
    # A follower's text goes to its leader; the hints keep all sizes on one plan.
    both = pairs.join(texts.toDF("b", "text_b").hint("merge"), "b").join(texts.toDF("a", "text_a").hint("merge"), "a").sortWithinPartitions("a")
    links = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(size, percent), "a long, b long"), "links")
    dropped(spark, texts, pairs)
    parts = stored(components(links), "parts")
    dropped(spark, links)
    again = met.filter("again").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    seen = stored(again.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "second_look")
    dropped(spark, met)
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("long")
    sizes = seen.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    mixed = sizes.filter(F.col("top.m") < F.col("all")).select("key", F.col("top.component").alias("largest"), blocks(F.col("top.m")).alias("k"), blocks(F.col("all") - F.col("top.m")).alias("o"))
    mixed = stored(mixed, "mixed")
    if mixed.isEmpty():
        dropped(spark, seen, mixed)
        return parts
    cells = stored(_cells(seen, heads, mixed), "cells")
    sorted_ = lambda rows: rows.repartition("cell").sortWithinPartitions("cell", "id")
    asked = stored(sorted_(cells).mapInArrow(_in_question(percent), "cell long, id long"), "in_question")
    texts = stored(_texts(docs, asked.select(F.col("id").alias("doc_id")).distinct()), "question_texts")
    left = cells.join(asked, ["cell", "id"]).join(texts.toDF("id", "text").hint("merge"), "id")
    extra = stored(sorted_(left).mapInArrow(_joined(size, percent), "a long, b long"), "more_links")
    dropped(spark, seen, mixed, cells, asked, texts)
    out = parts if extra.isEmpty() else stored(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(extra)), "joined_parts")
    dropped(spark, extra)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, a document's set the distinct shingles of ``size`` words.
    Documents are linked where 100 * intersection >= percent * union; ``component_id`` is the least id reachable and
    ``kept`` marks its row. Null, empty and blank texts have no shingles and are linked with nothing. Rows that share an id
    are one document. A row without id is linked with nothing: its component is null, and it is kept. Ids are whole
    numbers. An empty table gives an empty result; other columns are not read.
    """
    for_python(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(docs.mapInArrow(_signed(size), "doc_id long, n long, digest binary, sig binary"), "signatures")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "sig"))).alias("first")
    classes = signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(first, F.count("*").alias("rows"))
    classes = stored(classes.select("digest", F.col("first.doc_id").alias("id"), F.col("first.n").alias("n"), F.col("first.sig").alias("sig"), "rows"), "classes")
    # Classes that are led by the same id (rows of one id with several texts) are one document.
    parts = linked_classes(docs, classes.filter("id is not null").dropDuplicates(["id"]), size, percent)
    found = stored(classes.select("digest", "id", "rows").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("component"), "rows"), "class_parts")
    dropped(docs.sparkSession, classes)
    out = met_by_weight(signed.select("doc_id", "n", "digest"), found, "digest", "rows", signed.count())
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))
