"""Suffix arrays by two-stage sorting, and the removal of repeated byte strings built on them.

Two-stage sorting: only suffixes smaller than their successors are sorted directly; all others are induced by one scan of
the buckets from the left. Adjacent common prefixes then tell which strings of ``length`` bytes occur again.

No suffix array of the whole corpus fits in one task. Strings of ``length`` bytes that are equal hold equal anchors:
short strings whose hash is least within a window as long as that string leaves room for. Only the surroundings of anchors
that occur again, and not all with the same surroundings, are sorted; equal surroundings are settled by 128-bit hashes.

An anchor may have any number of different surroundings, as where one passage stands in a third of all documents. Beyond
``MANY`` of them they are not brought together: every string of ``length`` bytes around such an anchor is settled by its
own 128-bit hash, each task handing on the earliest of each alone, so no key gathers more rows than there are tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_python, stored, told_apart

#: Bytes of an anchor; at most the length of the strings looked for.
ANCHOR = 24
#: Anchors that a task gathers before it drops those it has seen with the same surroundings.
HELD = 1_000_000
#: Bytes of text whose anchors are found, or whose suffixes are sorted, in one go (one group of surroundings at least).
AT_ONCE = 1_500_000
#: Different surroundings of one anchor that may be sorted together.
MANY = 20_000
_draw = np.random.default_rng(19900601)
_BYTE = _draw.integers(0, 2**63, 256, dtype=np.uint64)
_BASE = int(_draw.integers(2**62, 2**63)) | 1
_NONE = np.uint64(2**64 - 1)


def first_of(group: np.ndarray) -> np.ndarray:
    """Whether each entry differs from the one before."""
    return np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)


def _packed(data: bytes, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number, with zeros behind the end."""
    n = len(data)
    text = np.zeros(n + depth + 16, np.uint64)
    text[:n] = np.frombuffer(data, np.uint8)
    out = text[: n + depth + 8].copy()
    for i in range(1, 8):
        out = (out << np.uint64(8)) | text[i : i + len(out)]
    return out


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """All suffixes of ``data`` in order of their first ``depth`` bytes; a shorter suffix precedes those it begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    text = np.frombuffer(data, np.uint8)
    step = np.full(n, -1, np.int8)  # the last suffix is greater than the empty one behind it
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    # Where a byte equals the next, the suffix is as its successor is.
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    smaller = step[nearest] > 0
    direct = _sorted_direct(_packed(data, depth), n, np.flatnonzero(smaller), depth)
    heads = text[direct]
    out: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # induced by the empty suffix, which comes first
    for c in range(256):
        bucket = []
        if waiting[c]:
            part = np.concatenate(waiting[c])
            waiting[c] = []
            while len(part):  # the scan of a bucket meets what it has itself induced
                bucket.append(part)
                part = part[part > 0] - 1
                part = part[(text[part] == c) & ~smaller[part]]
        lo, hi = np.searchsorted(heads, [c, c + 1])
        if hi > lo:
            bucket.append(direct[lo:hi])
        if not bucket:
            continue
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        if len(before):
            head = text[before]
            by = np.argsort(head, kind="stable")
            for p in np.split(before[by], np.flatnonzero(np.diff(head[by])) + 1):
                waiting[text[p[0]]].append(p)
    return np.concatenate(out)


def _sorted_direct(packed: np.ndarray, n: int, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes, eight at a time, only ties being read on; then by length."""
    order = at.copy()
    group = np.zeros(len(at), np.int64)  # first place of each suffix's group of ties
    open_ = np.arange(len(at))
    rounds = -(-depth // 8)
    for k in range(rounds + 1):
        if not len(open_):
            break
        if k == rounds:
            word = np.minimum(n - order[open_], depth).astype(np.uint64)
        else:
            word = packed[order[open_] + 8 * k]
            if 8 * k + 8 > depth:
                word = word >> np.uint64(8 * (8 * k + 8 - depth))
        by = np.lexsort((word, group[open_]))
        order[open_], word = order[open_][by], word[by]
        starts = np.flatnonzero(first_of(group[open_]) | first_of(word))
        size = np.diff(np.concatenate([starts, [len(open_)]]))
        group[open_] = np.repeat(open_[starts], size)
        open_ = open_[np.repeat(size, size) > 1]
    return order


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Length, ``most`` at most, of the prefix each suffix in ``order`` has in common with the one before (0 for the first)."""
    packed, out = _packed(data, most), np.zeros(len(order), np.int64)
    todo = np.arange(1, len(order))
    for k in range(-(-most // 8)):
        apart = packed[order[todo] + 8 * k] ^ packed[order[todo - 1] + 8 * k]
        same = np.full(len(todo), 8)
        for i in range(1, 9):
            same -= (apart >> np.uint64(64 - 8 * i)) != 0
        out[todo] += same
        todo = todo[apart == 0]
        if not len(todo):
            break
    room = len(data) - np.maximum(order[1:], order[:-1]) if len(order) else order
    out[1:] = np.minimum(out[1:], np.minimum(room, most))
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document in order, those that overlap or touch as one."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    new_doc = first_of(doc)
    shift = np.cumsum(new_doc) * np.int64(1 << 40)  # documents apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = new_doc | np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    firsts = np.flatnonzero(new)
    lasts = np.concatenate([firsts[1:], [len(doc)]]) - 1
    return doc[firsts], start[firsts], (reach - shift)[lasts]


def repeated(snippets: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, start, end) of all strings of ``length`` bytes in the snippets (document, place, bytes) that occur
    earlier in them, by document and then by place."""
    data = b"".join([x[2] for x in snippets])
    sizes = np.array([len(x[2]) for x in snippets])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(snippets)), sizes)
    within = np.arange(len(data)) - begins[owner]
    order = suffix_array(data, length)
    order = order[(sizes[owner] - within)[order] >= length]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    kind = np.cumsum(common_prefixes(data, order, length) < length)
    doc = np.array([x[0] for x in snippets], np.int64)[owner[order]]
    start = np.array([x[1] for x in snippets], np.int64)[owner[order]] + within[order]
    by = np.lexsort((start, doc, kind))
    kind, doc, start = kind[by], doc[by], start[by]
    firsts = np.maximum.accumulate(np.where(first_of(kind), np.arange(len(kind)), 0))
    later = (doc != doc[firsts]) | (start != start[firsts])
    return merged(doc[later], start[later], start[later] + length)


def _sliding(x: np.ndarray, width: int, best: np.ufunc, fill: np.uint64) -> np.ndarray:
    """``best`` over x[i : i + width], padded behind."""
    out, have = np.concatenate([x, np.full(width, fill)]), 1
    while have < width:
        by = min(have, width - have)
        out = best(out[:-by], out[by:])
        have += by
    return out[: len(x)]


def anchors(data: bytes, ends: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that follow each other in ``data`` and end at ``ends``.

    In every string of ``length`` bytes within a text, the least of its hashes of ``size`` bytes is an anchor.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, have, at = {1: _BYTE[np.frombuffer(data, np.uint8)]}, 1, None
    while 2 * have <= size:
        h = power[have]
        power[2 * have] = h[:-have] * np.uint64(pow(_BASE, have, 2**64)) + h[have:]
        have *= 2
    h, done = power[have], have
    for k in sorted(power, reverse=True):
        if size - done >= k:
            n = len(data) - done - k + 1
            h = h[:n] * np.uint64(pow(_BASE, k, 2**64)) + power[k][done : done + n]
            done += k
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    # A hash that would span two texts is none.
    text_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(h)]
    h[np.arange(len(h)) + size > text_end] = _NONE
    width = length - size + 1
    least = _sliding(h, width, np.minimum, _NONE)
    greatest = _sliding(least[::-1], width, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((h == greatest) & (h != _NONE))
    return at, h[at]


#: An anchor's hash, the two halves of its surroundings' hash, short hashes of the surroundings' sides, and where they lie.
#: Rows without ``s`` are spans that are repeats for certain; they end at ``t``.
ROWS = "h long, s long, t long, f long, doc_id long, at long"
NAMES = ["h", "s", "t", "f", "doc_id", "at"]
#: Where surroundings begin, how long they are and the anchor's place in them travel as one number.
PLACE = 16
LOW = (1 << PLACE) - 1
Rows = tuple[np.ndarray, ...]


def _arrow(cols: list[np.ndarray | None], names: list[str]) -> pa.RecordBatch:
    """Columns of 64-bit numbers; None is a column of nulls."""
    n = next(len(c) for c in cols if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in cols], names=names)


def _hashed(data: bytes, cuts: Iterable[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of data[x:y] under a seed, as two halves."""
    out = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[x:y], seed) for x, y, seed in cuts]), ">u8").reshape(-1, 2)
    return out[:, 0].astype(np.uint64), out[:, 1].astype(np.uint64)


def _half(length: int) -> int:
    """Bytes on one side of an anchor that are part of a key: of every string around it the half of what is left for sides."""
    return (length - ANCHOR) // 2


def _sides(p: int, a: int, e: int, length: int) -> tuple[tuple[int, int, int, int], tuple[int, int, int, int]]:
    """For the keys before and behind the anchor at p, in surroundings a to e: the key's bytes, and those to be compared."""
    half = _half(length)
    lo, hi = max(a, p - half), min(e, p + ANCHOR + half)
    return (lo, p + ANCHOR, a, hi), (p, hi, lo, e)


def _whole(side: tuple[int, int, int, int], length: int) -> bool:
    """Whether a string of ``length`` bytes can be found under the key."""
    return side[1] - side[0] == _half(length) + ANCHOR and side[3] - side[2] >= length


def _handed_on(rows: list[Rows]) -> Iterator[pa.RecordBatch]:
    """A task's rows (see ``ROWS``): the earliest of each anchor and surroundings, and the spans of the others, which are
    repeats for certain."""
    h, s, t, f, doc, at = (np.concatenate([x[i] for x in rows]) for i in range(6))
    by = np.lexsort((at, doc, t, s, h))
    h, s, t, f, doc, at = h[by], s[by], t[by], f[by], doc[by], at[by]
    new = first_of(h) | first_of(s) | first_of(t)
    firsts = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = (doc != doc[firsts]) | (at != at[firsts])
    for i in range(0, int(new.sum()), 50_000):
        yield _arrow([x[new][i : i + 50_000] for x in (h, s, t, f, doc, at)], NAMES)
    doc, a, e = merged(doc[later], *_span(at[later]))
    if len(doc):
        yield _arrow([doc ^ a, None, e, None, doc, a], NAMES)


def _span(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = at >> 2 * PLACE
    return a, a + (at >> PLACE & LOW)


def _surroundings(size: int, length: int) -> Callable:
    """Anchors with the hash and place of their surroundings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []

        def found(part: list[tuple[int, bytes]]) -> None:
            data, sizes = b"".join([x[1] for x in part]), np.array([len(x[1]) for x in part])
            ends = np.cumsum(sizes)
            at, h = anchors(data, ends, size, length)
            owner = np.searchsorted(ends, at, "right")
            lo, hi = np.maximum(at - (length - size), (ends - sizes)[owner]), np.minimum(at + length, ends[owner])
            s, t = _hashed(data, zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True))
            short = np.zeros((2, len(at)), np.uint64)
            half = _half(length)
            for k, (x, y, room) in enumerate(((at - half, at + size, np.minimum(at + size + half, hi) - lo), (at, at + size + half, hi - np.maximum(at - half, lo)))):
                ok = np.flatnonzero((x >= lo) & (y <= hi) & (room >= length))
                short[k, ok] = [xxhash.xxh32_intdigest(data[i:j], k) | 1 for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True)]
            begin = (ends - sizes)[owner]
            held.append((h, s, t, short[0] << np.uint64(32) | short[1], np.array([x[0] for x in part], np.int64)[owner], (lo - begin << 2 * PLACE) | (hi - lo << PLACE) | at - lo))

        for batch in batches:
            part, size_ = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                if doc is not None and len(raw) >= length:
                    part.append((doc, raw))
                    size_ += len(raw)
                if size_ > AT_ONCE:
                    found(part)
                    part, size_ = [], 0
            if part:
                found(part)
            if sum(len(x[0]) for x in held) > HELD:
                yield from _handed_on(held)
                held.clear()
        if held:
            yield from _handed_on(held)

    return run


#: What ``_settled`` gives: spans that are repeats (kind 0), surroundings to be sorted under the key before the anchor (1),
#: behind it (2) or both (3), and surroundings of an anchor that has too many (4).
SETTLED = "kind long, doc_id long, a long, b long"
SURE, BEFORE, BEHIND, HOT = 0, 1, 2, 4


def _shared(group: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Which of its sides (see ``SETTLED``) each of the surroundings has in common with another of its group."""
    out = np.zeros(len(f), np.int64)
    for kind, short in ((BEFORE, f >> np.uint64(32)), (BEHIND, f & np.uint64(0xFFFFFFFF))):
        by = np.lexsort((short, group))
        same = (group[by][1:] == group[by][:-1]) & (short[by][1:] == short[by][:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(f) else np.zeros(0, bool)
        out[by[twice & (short[by] != 0)]] |= kind
    return out


def _settled(many: int) -> Callable:
    """From rows sorted by h, s, t, doc_id, at: the spans that are repeats, and of anchors with several surroundings the
    earliest of each that has a side in common with another. Holds the ``many`` first surroundings of one anchor."""
    names = ["kind", "doc_id", "a", "b"]

    def sure(doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        return _arrow([np.zeros(len(doc), np.int64), doc, a, e], names)

    def rest(kind: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        a, e = _span(at[kind > 0])
        return _arrow([kind[kind > 0], doc[kind > 0], a, e << PLACE | at[kind > 0] & LOW], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # h, s, t, doc, at of the first row with the surroundings met last
        held: list[Rows] = []  # f, doc, at of the first surroundings of the anchor met last
        hot = False  # that anchor is known to have too many

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal hot
            if sum(len(x[0]) for x in held) > 1 and not hot:
                f, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
                yield rest(_shared(np.zeros(len(f), np.int64), f), doc, at)
            held.clear()
            hot = False

        for b in batches:
            known = b.filter(pc.is_null(b.column("s")))
            if known.num_rows:
                yield sure(*(known.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "at", "t")))
            b = b.filter(pc.is_valid(b.column("s")))
            n = b.num_rows
            if not n:
                continue
            h, s, t, f, doc, at = (b.column(c).to_numpy(zero_copy_only=False) for c in NAMES)
            new_h = first_of(h)
            new_h[0] = last is None or h[0] != last[0]
            new_s = new_h | first_of(s) | first_of(t)
            new_s[0] = new_h[0] or s[0] != last[1] or t[0] != last[2]
            top = np.maximum.accumulate(np.where(new_s, np.arange(n), -1))
            first_doc = np.where(top >= 0, doc[top], last[3] if last else 0)
            first_at = np.where(top >= 0, at[top], last[4] if last else 0)
            later = ~new_s & ((doc != first_doc) | (at != first_at))
            spans = merged(doc[later], *_span(at[later]))
            if len(spans[0]):
                yield sure(*spans)
            tops = np.flatnonzero(new_s)
            if not len(tops):
                continue
            i = tops[-1]
            last = (h[i], s[i], t[i], doc[i], at[i])
            # By anchor: the first part may go on with the anchor met last, the last part may go on in the next batch.
            cuts = np.flatnonzero(new_h[tops])
            bounds = np.concatenate([[0], cuts[cuts > 0], [len(tops)]])
            sizes = np.diff(bounds)
            rows = f[tops].view(np.uint64), doc[tops], at[tops]
            one_by_one = sizes > many
            one_by_one[[0, -1]] = True
            inside = np.repeat(~one_by_one & (sizes > 1), sizes)
            if inside.any():
                yield rest(_shared(np.repeat(np.arange(len(sizes)), sizes)[inside], rows[0][inside]), rows[1][inside], rows[2][inside])
            for k in np.flatnonzero(one_by_one).tolist():
                part = tuple(x[bounds[k] : bounds[k + 1]] for x in rows)
                if new_h[tops[bounds[k]]]:
                    yield from ended()
                if not hot:
                    held.append(part)
                    if sum(len(x[0]) for x in held) > many:
                        hot, part = True, tuple(np.concatenate(x) for x in zip(*held, strict=True))
                if hot:
                    yield rest(np.full(len(part[0]), HOT), *part[1:])
        yield from ended()

    return run


def _windows(length: int) -> Callable:
    """Every string of ``length`` bytes around anchors with many surroundings, as rows like those of ``_surroundings``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        for b in batches:
            for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                starts: set[int] = set()
                for x in spans:
                    a, e = x["a"], x["b"] >> PLACE
                    p = a + x["b"] % (1 << PLACE)
                    starts.update(range(max(a, p + ANCHOR - length), min(p, e - length) + 1))
                if starts:
                    at = np.array(sorted(starts), np.int64)
                    s, t = _hashed(raw, ((i, i + length, 0) for i in at.tolist()))
                    held.append((s, s, t, np.zeros(len(at), np.uint64), np.full(len(at), doc), (at << 2 * PLACE) | length << PLACE))
            if sum(len(x[0]) for x in held) > HELD:
                yield from _handed_on(held)
                held.clear()
        if held:
            yield from _handed_on(held)

    return run


def _cut_out(length: int) -> Callable:
    """Surroundings, keyed by what lies before their middle, by what lies behind it, or both.

    A string of ``length`` bytes around an anchor has half of what is left for its sides before the anchor, or behind it;
    so two equal ones meet under one of the keys, and a frequent anchor's rows do not all come together.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, docs, places, parts = [], [], [], []
            for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                for x in spans:
                    a, e = x["a"], x["b"] >> PLACE
                    for kind, side in zip((BEFORE, BEHIND), _sides(a + (x["b"] & LOW), a, e, length), strict=True):
                        if x["kind"] & kind and _whole(side, length):
                            key.append(xxhash.xxh3_64_intdigest(raw[side[0] : side[1]], kind) - 2**63)
                            docs.append(doc)
                            places.append(side[2])
                            parts.append(raw[side[2] : side[3]])
                if len(key) > 20_000:
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "a": pa.array(places, pa.int64()), "part": pa.array(parts, pa.binary())})
                    key, docs, places, parts = [], [], [], []
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "a": pa.array(places, pa.int64()), "part": pa.array(parts, pa.binary())})

    return run


def _compared(length: int) -> Callable:
    """Repeats among the cut-out parts, which come sorted by key; parts that share no key with others are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int, int, bytes]] = []
        group: list[tuple[int, int, bytes]] = []
        seen: dict[bytes, tuple[int, int]] = {}  # parts of the group: equal ones are settled without sorting
        sure: list[tuple[int, int, int]] = []
        key, size = None, 0

        def out() -> pa.RecordBatch:
            spans = repeated(ready, length) if ready else (np.zeros(0, np.int64),) * 3
            if sure:
                spans = merged(*(np.concatenate([x, y]) for x, y in zip(spans, np.array(sure, np.int64).T, strict=True)))
            ready.clear()
            sure.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans], names=["doc_id", "a", "b"])

        for b in batches:
            for k, doc, a, part in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "a", "part")), strict=True):
                if k != key:
                    if len(group) > 1:
                        ready += group
                        size += sum(len(x[2]) for x in group)
                        if size > AT_ONCE:
                            yield out()
                            size = 0
                    key, group = k, []
                    seen.clear()
                first = seen.setdefault(part, (doc, a))  # rows come by document and place
                if first != (doc, a):
                    sure.append((doc, a, a + len(part)))
                elif not group or group[-1][:2] != (doc, a):
                    group.append((doc, a, part))
            if len(sure) > 50_000:
                yield out()
                size = 0
        if len(group) > 1:
            ready += group
        if ready or sure:
            yield out()

    return run


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, sizes, removed, runs = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode()
            kept, at, n, gone = [], 0, 0, 0
            for a, e in zip(*(x.tolist() for x in merged(*_columns(spans))[1:]), strict=True) if spans else ():
                kept.append(raw[at:a])
                at, n, gone = e, n + 1, gone + e - a
            kept.append(raw[at:])
            texts.append(b"".join(kept))
            sizes.append(len(raw))
            removed.append(gone)
            runs.append(n)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(texts, pa.binary())})


def _columns(spans: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.array([x["a"] for x in spans], np.int64)
    return np.zeros(len(a), np.int64), a, np.array([x["b"] for x in spans], np.int64)


def remove_repeats(docs: DataFrame, length: int = 100, many: int = MANY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay; perhaps no valid UTF-8).

    A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or
    before it in the same. Matches lie within one document; what is removed elsewhere plays no part. Null text counts as
    empty. Of rows that share an id those with equal texts are one document, the others follow each other in the order of a
    hash; a row without id is not compared and keeps all its bytes. An anchor with more than ``many`` different surroundings is settled string by string. Ids are whole numbers. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    if not ANCHOR < length < (1 << PLACE - 1):
        raise ValueError(f"length must be between {ANCHOR} and {1 << PLACE - 1}")
    for_python(spark)
    docs = told_apart(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", "doc_id")
    sure = lambda rows: rows.filter(F.col("kind") == SURE).select("doc_id", "a", "b")
    by_doc = lambda rows: rows.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", *(["kind"] if "kind" in rows.columns else []))).alias("spans"))
    settled = lambda rows, what: stored(rows.repartition("h").sortWithinPartitions("h", "s", "t", "doc_id", "at").mapInArrow(_settled(many), SETTLED), what)
    found = settled(docs.mapInArrow(_surroundings(ANCHOR, length), ROWS), "anchors")
    spans, hot = sure(found), found.filter(F.col("kind") == HOT)
    if not hot.isEmpty():
        spans = spans.unionByName(sure(settled(docs.join(by_doc(hot), "doc_id").mapInArrow(_windows(length), ROWS), "strings")))
    parts = docs.join(by_doc(found.filter(F.col("kind").between(BEFORE, BEFORE | BEHIND))), "doc_id").mapInArrow(_cut_out(length), "key long, doc_id long, a long, part binary")
    more = stored(parts.repartition("key").sortWithinPartitions("key", "doc_id", "a").mapInArrow(_compared(length), "doc_id long, a long, b long"), "repeats")
    spans = by_doc(spans.unionByName(more))
    return docs.join(spans, "doc_id", "left").mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
