"""A probabilistic suffix tree over words: built from counts of the whole corpus, used to score whole texts.

Symbols are the words with at least ``p_symbol`` of all training tokens and one class for all others, whose members share
the class's probability by their counts. Every run of symbols seen ``MIN_COUNT`` times is a transition, and every context
with a transition is a candidate: the tree grows with the corpus. A context is retained when what follows it diverges
enough from what follows its longest retained proper suffix; its distribution is then its own discounted counts and, for
what the discount frees, its suffix's, so it sums to one.

Texts are turned into symbols once and kept as a table. Tokens go once to lanes by the last word of their context, packed many
to a row; a lane has all that follows its contexts, so it counts them, tests them against their suffixes and scores its tokens,
and gives back sums for each text. A word with more tokens than a lane should have, and so on for longer contexts, is counted
beforehand, has several lanes, and each of them gets its counts. No task and no worker holds the tree. ``SuffixTree`` is the
same tree in memory, for small alphabets and for tests.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, for_python, stored, words

#: Taken from the count of every seen transition; what it frees is spread by the suffix's distribution.
DISCOUNT = 0.5
#: Added to every word's count, unseen words together counting as one more.
ADDED = 0.1
#: The end of a text, as a word; no word is empty.
END = b""
#: Longest word that can be a symbol, in bytes; longer words are members of the class of rare words.
SYMBOL_BYTES = 64
#: Transitions seen less often say nothing of their own.
MIN_COUNT = 2
#: Bits of a symbol in a packed context; words of a context at most.
BITS, DEEPEST = 21, 3
MASK = (1 << BITS) - 1
#: Distinct counts, or tokens, that a task holds before it hands them on.
HELD = 1_000_000
#: Tokens of a lane, as a goal, where there are many and where there are few.
LANE, LEAST = 1_000_000, 100_000


@dataclass
class Level:
    """Contexts of one length, and their transitions as codes context * symbols + next symbol, sorted."""

    candidate: np.ndarray
    count: np.ndarray
    suffix: np.ndarray
    codes: np.ndarray
    code_counts: np.ndarray
    prob: np.ndarray = field(default_factory=lambda: np.zeros(0))
    retained: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _find(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions in sorted ``codes``, -1 where absent."""
    if not len(codes):
        return np.full(len(x), -1)
    at = np.searchsorted(codes, x)
    at[at == len(codes)] = 0
    return np.where(codes[at] == x, at, -1)


class SuffixTree:
    def __init__(self, symbols: dict[bytes, int], counts: np.ndarray, total: int, distinct: int, frequent: np.ndarray):
        self.symbols, self.n, self.levels = symbols, len(counts), []
        self.total, self.distinct, self.frequent, self.counts = total, distinct, frequent, counts
        rare_types = distinct - len(symbols)
        self.whole = total + ADDED * (distinct + 1)
        self.rare_whole = counts[0] + ADDED * (rare_types + 1)
        self.root = (counts + ADDED) / self.whole
        self.root[0] = self.rare_whole / self.whole

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each with its end, and where each text starts."""
        get = self.symbols.get
        ids = np.array([get(w, 0) for ws in texts for w in (*ws, END)], np.int64)
        return ids, np.cumsum([0, *(len(ws) + 1 for ws in texts)])[:-1]

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each length the context before each token (-1: none), and the longest run that ends with each token."""
        first = np.zeros(len(ids), bool)
        first[starts] = True

        def before(end: np.ndarray) -> np.ndarray:
            out = np.concatenate([[-1], end[:-1]]) if len(end) else end
            out[first] = -1
            return out

        end = np.where(self.frequent[ids], ids, -1)
        found = [before(end)]
        for level in self.levels:
            ctx = found[-1]
            at = np.flatnonzero(ctx >= 0)
            end = np.full(len(ids), -1)
            end[at] = _find(level.codes, ctx[at] * self.n + ids[at])
            found.append(before(end))
        return found, end

    def grams(self, texts: list[list[bytes]]) -> np.ndarray:
        """Codes of the transitions from the longest contexts so far whose own suffixes are counted too."""
        ids, starts = self.read(texts)
        found, end = self.contexts(ids, starts)
        ok = (found[-1] >= 0) & (end >= 0)
        return found[-1][ok] * self.n + ids[ok]

    def grow(self, codes: np.ndarray, counts: np.ndarray, min_gain: float) -> None:
        """Add a level from counted transitions, and test which of its contexts diverge from their suffixes."""
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(float)
        if not self.levels:
            count, suffix = self.counts.astype(float), np.full(self.n, -1)
        else:
            below = self.levels[-1]
            count, ctx, last = below.code_counts, below.codes // self.n, below.codes % self.n
            # The suffix of context (c, last) is (suffix of c, last); of length one it is the last symbol itself.
            suffix = last if len(self.levels) == 1 else _find(self.levels[-2].codes, below.suffix[ctx] * self.n + last)
        new = Level(count >= 0, count, suffix, codes, counts)
        k = len(self.levels) + 1
        ctx, symbol = codes // self.n, codes % self.n
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(count[ctx], 1)
        lower = self._prob(k - 1, suffix[ctx], symbol)
        add = lambda x: np.bincount(ctx, x, len(count))
        seen, new.spread = add(counts), 1 - add(own)
        new.prob = own + new.spread[ctx] * lower
        gain = add(counts * np.log(new.prob / lower)) + (count - seen) * np.log(np.maximum(new.spread, 1e-12))
        new.retained = gain >= min_gain
        self.levels.append(new)

    def _prob(self, k: int, ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probability of ``symbol`` after contexts of length k, by the longest retained suffix of each."""
        out = self.root[symbol]
        if k == 0 or not len(ctx):
            return out
        level = self.levels[k - 1]
        has = ctx >= 0
        kept = has.copy()
        kept[has] = level.retained[ctx[has]]
        entry = np.full(len(ctx), -1)
        entry[kept] = _find(level.codes, ctx[kept] * self.n + symbol[kept])
        seen = entry >= 0
        out[seen] = level.prob[entry[seen]]
        if len(rest := np.flatnonzero(has & ~seen)):
            down = self._prob(k - 1, level.suffix[ctx[rest]], symbol[rest])
            out[rest] = down * np.where(kept[rest], level.spread[ctx[rest]], 1.0)
        return out

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each token's symbol."""
        found, _ = self.contexts(ids, starts)
        out, todo = np.zeros(len(ids)), np.ones(len(ids), bool)
        for k in range(len(self.levels), -1, -1):
            at = np.flatnonzero(todo if k == 0 else todo & (found[k - 1] >= 0))
            out[at] = self._prob(k, found[k - 1][at] if k else at, ids[at])
            todo[at] = False
        return np.log10(np.maximum(out, 1e-300))


def held_out(id_col: str = "doc_id", parts: int = 10) -> Column:
    """One document in ``parts``, by the CRC of its id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def _texts(b: pa.RecordBatch) -> list[list[bytes]]:
    return [words(x) for x in b.column("text").to_pylist()]


def _counted(source: DataFrame) -> DataFrame:
    """(word, n) over all texts and their ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return made

        for b in batches:
            for ws in _texts(b):
                held.update(ws)
            held[END] += b.num_rows
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    return source.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encoded(source: DataFrame, sent: Broadcast, schema: T.StructType) -> DataFrame:
    """Every text as symbols, with its rare words and the sums of its words' own log probabilities."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, model = to_arrow_schema(schema), sent.value
        base_log, root_log = np.log10(model.root), np.log10(model.root)
        base_log[0] = 0
        for b in batches:
            if not b.num_rows:
                continue
            flat: list[bytes] = []
            starts = np.zeros(b.num_rows, np.int64)
            for i, ws in enumerate(_texts(b)):
                starts[i] = len(flat)
                flat += ws
                flat.append(END)
            ids = np.fromiter(map(model.symbols.get, flat, repeat(0)), np.int64, len(flat))
            by_text = lambda x: np.add.reduceat(x, starts)
            n_rare = by_text((ids == 0).astype(np.int64))
            ends = np.cumsum(n_rare)
            rare = [flat[i] for i in np.flatnonzero(ids == 0)]
            few = [Counter(rare[i:j]) for i, j in zip(ends - n_rare, ends, strict=True)]
            pairs = pa.StructArray.from_arrays([pa.array([w for x in few for w in x], pa.binary()), pa.array([n for x in few for n in x.values()], pa.int64())], fields=list(arrow.field("rare").type.value_type))
            offsets = pa.array(np.cumsum([0, *map(len, few)]), pa.int32())
            cuts = np.split(ids.astype(np.uint32), starts[1:])
            made = {
                "row": b.column("row"), "doc_id": b.column("doc_id"), "train": b.column("train"), "n_tokens": pa.array(np.diff([*starts, len(ids)])), "n_rare": pa.array(n_rare),
                "base": pa.array(by_text(base_log[ids]) - n_rare * np.log10(model.whole)), "score": pa.array(by_text(root_log[ids]) - n_rare * np.log10(model.rare_whole)),
                "ids": pa.array([x.tobytes() for x in cuts], pa.binary()), "rare": pa.ListArray.from_arrays(offsets, pairs, arrow.field("rare").type),
            }
            yield pa.RecordBatch.from_arrays([made[f.name] for f in arrow], schema=arrow)

    return source.mapInArrow(run, schema)


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of a batch of texts, the text of each, and its place in it."""
    raw = column.to_pylist()
    sizes = np.array([len(x) // 4 for x in raw])
    ids = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(raw)), sizes)
    return ids, text, np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _turned(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The packed symbols before each token, the last one in the highest bits, zeros where its text has none: contexts with a
    common end lie together, and a shorter context is what is left when the lowest symbols are shifted out."""
    out = np.zeros(len(ids), np.int64)
    for back in range(1, DEEPEST + 1):
        out[back:] |= np.where(place[back:] >= back, ids[:-back], 0) << BITS * (DEEPEST - back)
    return out


def _ends(turned: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of contexts."""
    return turned >> BITS * (DEEPEST - k)


def _hash(x: np.ndarray) -> np.ndarray:
    """Spreads packed symbols; the same in every task."""
    x = (x.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(8)).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Of each column all first bytes before all second ones, compressed."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, types: list) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(packed, n * sum(widths), "zstd", asbytes=True), np.uint8)
    cuts = np.split(raw, n * np.cumsum(widths)[:-1])
    return [np.ascontiguousarray(c.reshape(w, n).T).view(t).ravel() for c, w, t in zip(cuts, widths, types, strict=True)]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


@dataclass
class Lanes:
    """How tokens are dealt: by the last word of their contexts, to about ``size`` tokens a lane.

    A word with more is a hot context. It has lanes of its own, from ``first`` on, ``many`` of them, to which its tokens go by
    their shortest context that is not hot. ``hot`` has for each length the hot contexts, sorted, and ``whole`` how often each
    was seen; what follows them is counted beforehand and sent to all lanes of their last word. All other contexts lie in one
    lane with all that follows them.
    """

    n: int
    size: int
    first: np.ndarray
    many: np.ndarray
    hot: list[np.ndarray]
    whole: list[np.ndarray]

    @classmethod
    def over(cls, counts: np.ndarray, partitions: int) -> Lanes:
        """From the counts of the symbols that can be in a context."""
        size = max(min(int(counts.sum()) // partitions, LANE), min(LANE, LEAST)) + 1
        many = np.where(counts > size, -(-counts // size), 0)
        hot = np.flatnonzero(many)
        own = int(many.sum())
        lane = own + np.cumsum(np.where(many, 0, counts)) // size
        lane[hot] = np.cumsum(many[hot]) - many[hot]
        return cls(int(max(lane.max() + 1, own)), size, lane, many, [hot], [counts[hot]])

    def lane(self, turned: np.ndarray, row: np.ndarray, depth: int) -> np.ndarray:
        last = _ends(turned, 1)
        out = self.first[last]
        at = np.flatnonzero(self.many[last])
        key = _hash(row[at])
        for k in range(depth, 1, -1):
            ctx = _ends(turned[at], k)
            cold = _find(self.hot[k - 1], ctx) < 0 if k <= len(self.hot) else np.ones(len(at), bool)
            key[cold] = _hash(ctx[cold])
        out[at] += key % self.many[last[at]]
        return out


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and their counts added up."""
    codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)


def _hot_runs(k: int, lanes: Broadcast) -> Callable:
    """Of the texts that are learnt from, what follows hot contexts of k symbols, added up in part; a code is a context's number
    and a symbol. Codes go to as many buckets as there are lanes, many to a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        hot, size = lanes.value.hot[k - 1], 0

        def out() -> pa.RecordBatch:
            codes, n = held[0]
            bucket = _hash(codes) % lanes.value.n
            order = np.argsort(bucket, kind="stable")
            codes, n, bucket = codes[order], n[order], bucket[order]
            cuts = _starts(bucket)
            slices = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(codes)], strict=True)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts], pa.int32()), "n": pa.array([s.stop - s.start for s in slices], pa.int32()), "codes": pa.array([_packed(codes[s], n[s]) for s in slices], pa.binary())})

        for b in batches:
            if not b.num_rows:
                continue
            ids, _, place = _symbols(b.column("ids"))
            which = _find(hot, _ends(_turned(ids, place), k))
            ok = (which >= 0) & (place >= k)
            held.append(np.unique(which[ok] << BITS | ids[ok], return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held[:] = [_merged(held)]
                size = len(held[0][0])
                if 2 * size > HELD:
                    yield out()
                    held.clear()
                    size = 0
        if size:
            held[:] = [_merged(held)]
            yield out()

    return run


def _hot_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) seen ``MIN_COUNT`` times, from rows of ``_hot_runs`` sorted by bucket. Holds the codes of one bucket."""
    last, held, size = None, [], 0

    def out() -> pa.RecordBatch:
        codes, n = _merged(held)
        return pa.RecordBatch.from_pydict({"code": pa.array(codes[n >= MIN_COUNT]), "n": pa.array(n[n >= MIN_COUNT])})

    for b in batches:
        for bucket, m, codes in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "codes")), strict=True):
            if held and bucket != last:
                yield out()
                held, size = [], 0
            last = bucket
            held.append(tuple(_unpacked(codes, m, [np.int64, np.int64])))
            size += m
            if size > HELD:
                held = [_merged(held)]
                size = 0
    if held:
        yield out()


LANED = "lane int, level int, chunk long, n int, rows binary, tokens binary"
#: What is packed of a token: the number of words before it in bits 0 and 1, whether it is learnt from in bit 2 and begins
#: another text in bit 3; its symbol, and the symbols before it, the last one first. Of the tree: how often it was seen.
TOKEN = [np.uint8, *[np.uint32] * (1 + DEEPEST)]
NODE = [np.int64, *[np.uint32] * (1 + DEEPEST)]


def _laned(columns: dict[str, list], n: int) -> pa.RecordBatch:
    types = {"lane": pa.int32(), "level": pa.int32(), "chunk": pa.int64(), "n": pa.int32(), "rows": pa.binary(), "tokens": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))


def _words(turned: np.ndarray) -> list[np.ndarray]:
    return [(turned >> BITS * k & MASK).astype(np.uint32) for k in reversed(range(DEEPEST))]


def _packed_rows(rows: np.ndarray) -> bytes:
    """Rising numbers, as differences."""
    return _packed(np.diff(rows, prepend=0))


def _tree_rows(k: int, lanes: Broadcast) -> Callable:
    """What follows hot contexts of k symbols, for each lane of their last word, many to a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = lanes.value
        for b in batches:
            code, n = b.column("code").to_numpy(), b.column("n").to_numpy()
            turned = deal.hot[k - 1][code >> BITS] << BITS * (DEEPEST - k)
            last = _ends(turned, 1)
            order = np.argsort(last, kind="stable")
            cuts = _starts(last[order])
            for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
                at = order[i:j]
                word, packed = last[at[0]], _packed(n[at], (code[at] & MASK).astype(np.uint32), *_words(turned[at]))
                m = int(deal.many[word])
                yield _laned({"lane": deal.first[word] + np.arange(m), "level": [k] * m, "n": [j - i] * m, "tokens": [packed] * m}, m)

    return run


def _token_rows(depth: int, lanes: Broadcast) -> Callable:
    """A task's tokens by lane, many to a row, in the order of their texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal chunk
            chunk += 1
            row, turned, x, flag = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            lane = lanes.value.lane(turned, row, depth)
            order = np.argsort(lane.astype(np.uint16) if lanes.value.n < 1 << 16 else lane, kind="stable")
            row, turned, x, flag, lane = row[order], turned[order], x[order], flag[order], lane[order]
            cuts = _starts(lane)
            new = np.concatenate([[True], row[1:] != row[:-1]])
            new[cuts] = True
            flag |= new.astype(np.uint8) << 3
            columns = [flag, x, *_words(turned)]
            slices = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(lane)], strict=True)]
            rows = [_packed_rows(row[s][new[s]]) for s in slices]
            return _laned({"lane": lane[cuts], "level": [0] * len(cuts), "chunk": [chunk] * len(cuts), "n": [s.stop - s.start for s in slices], "rows": rows, "tokens": [_packed(*(c[s] for c in columns)) for s in slices]}, len(cuts))

        for b in batches:
            if not b.num_rows:
                continue
            ids, text, place = _symbols(b.column("ids"))
            ok = place > 0
            if not ok.any():
                continue
            learnt = b.column("train").to_numpy(zero_copy_only=False)[text]
            flag = np.minimum(place, DEEPEST).astype(np.uint8) | learnt.astype(np.uint8) << 2
            held.append((b.column("row").to_numpy()[text[ok]], _turned(ids, place)[ok], ids[ok].astype(np.uint32), flag[ok]))
            size += len(held[-1][0])
            if size > HELD:
                yield out()
                size = 0
        if size:
            yield out()

    return run


@dataclass
class Judge:
    """What a lane needs besides its rows: how contexts are dealt, the symbols' own probabilities, and what a context must have."""

    lanes: Lanes
    root: np.ndarray
    depth: int
    least: float
    min_gain: float

    def lane(self, lane: int, tree: list[tuple], blocks: list[tuple]) -> Iterator[dict]:
        """(chunk, rows, adds, contexts): what the contexts of a lane add to the log10 probabilities of the texts of each block,
        and how many contexts are retained."""
        parts = [_unpacked(tokens, n, TOKEN) for _, n, _, tokens in blocks]
        sizes = [len(c[0]) for c in parts]
        flag, x, *before = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, t) for t in TOKEN]
        del parts
        place, learnt, n_tokens = flag & 3, (flag & 4) > 0, len(flag)
        turned = np.zeros(n_tokens, np.int64)
        for c in before:
            turned = turned << BITS | c
        counts = [learnt & (place >= k) for k in range(1, self.depth + 1)]
        del before
        mine = self.lanes.hot if lane < self.lanes.many.sum() else []  # a lane of a hot word
        if mine:
            for k, hot in enumerate(mine, 1):
                counts[k - 1] &= _find(hot, _ends(turned, k)) < 0
            for level, n, tokens in tree:
                seen, symbol, *ws = _unpacked(tokens, n, NODE)
                ctx = np.zeros(n, np.int64)
                for c in ws:
                    ctx = ctx << BITS | c
                turned, x = np.concatenate([turned, ctx]), np.concatenate([x, symbol])
                counts = [np.concatenate([c, seen if k == level else np.zeros(n)]) for k, c in enumerate(counts, 1)]

        # From the longest contexts to the shortest: distinct contexts, distinct transitions, and how often each was seen.
        levels: list[tuple[np.ndarray, ...]] = []
        keys, x = _ends(turned, self.depth), x.astype(np.int64)
        del turned
        for _ in range(self.depth):
            ctxs, which = np.unique(keys, return_inverse=True)
            codes, at = np.unique(which << BITS | x, return_inverse=True)
            counts = [np.bincount(at, c, len(codes)) for c in counts]
            which, x = codes >> BITS, codes & MASK
            levels.append((ctxs, which, x, counts.pop(), at))
            keys = ctxs[which] >> BITS
        value, retained, logs = self.root[x], 0, []
        for k, (ctxs, which, x, n, at) in enumerate(reversed(levels), 1):
            lower = value if k == 1 else value[levels[self.depth - k + 1][4]]
            whole, own_ = np.bincount(which, n, len(ctxs)), np.ones(len(ctxs), bool)
            if k <= len(mine):
                found = _find(ctxs, mine[k - 1])
                whole[found[found >= 0]] = self.lanes.whole[k - 1][found >= 0]
                own_[found[found >= 0]] = lane == self.lanes.first[mine[k - 1][found >= 0] >> BITS * (k - 1)]  # counted in one of its lanes
            seen = (n >= MIN_COUNT) & (whole[which] >= self.least)
            ctx, m, low = which[seen], n[seen], lower[seen]
            add = lambda v: np.bincount(ctx, v, len(ctxs))  # noqa: B023, E731
            spread = 1 - add(m - DISCOUNT) / np.maximum(whole, 1)
            own = (m - DISCOUNT) / whole[ctx] + spread[ctx] * low
            gain = add(m * np.log(own / low)) + (whole - add(m)) * np.log(spread)
            kept = (gain >= self.min_gain) & (add(None) > 0)
            retained += int((kept & own_).sum())
            value = np.where(kept[which], spread[which], 1.0) * lower
            value[seen] = np.where(kept[ctx], own, low)
            logs.append(np.log10(value / self.root[x]))
        yield {"chunk": -1 - lane, "rows": None, "adds": None, "contexts": retained}
        if not n_tokens:
            return
        at = levels[0][4][:n_tokens]
        added, short = logs[-1][at], np.flatnonzero(place < self.depth)
        at = at[short]
        for k in range(self.depth - 1, 0, -1):
            at = levels[self.depth - k][4][at]
            here = place[short] == k
            added[short[here]] = logs[k - 1][at[here]]
        starts = np.flatnonzero(flag & 8)
        sums = np.add.reduceat(added, starts)
        cuts = np.searchsorted(starts, np.cumsum([0, *sizes]))
        for (chunk, _, rows, _), i, j in zip(blocks, cuts[:-1], cuts[1:], strict=True):
            yield {"chunk": chunk, "rows": rows, "adds": sums[i:j].tobytes(), "contexts": 0}


SUMS = pa.schema({"chunk": pa.int64(), "rows": pa.binary(), "adds": pa.binary(), "contexts": pa.int64()})


def _judged(judge: Broadcast) -> Callable:
    """Rows of ``Judge.lane`` from rows of ``LANED`` sorted by lane. Holds one lane."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, tree, blocks = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            for found in judge.value.lane(lane, tree, blocks):
                yield pa.RecordBatch.from_pylist([found], SUMS)
            tree.clear()
            blocks.clear()

        for b in batches:
            for at, level, chunk, n, rows, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != lane and lane is not None:
                    yield from out()
                lane = at
                if level:
                    tree.append((level, n, tokens))
                else:
                    blocks.append((chunk, n, rows, tokens))
        if lane is not None:
            yield from out()

    return run


def _by_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, add, contexts) from rows of ``_judged`` sorted by chunk: one for each text, and one for each lane's contexts. Holds
    one chunk, whose texts a task had at once."""
    last, held = None, []

    def out() -> pa.RecordBatch:
        rows = np.concatenate([np.cumsum(_unpacked(r, len(a) // 8, [np.int64])[0]) for r, a in held])
        rows, at = np.unique(rows, return_inverse=True)
        added = np.bincount(at, np.concatenate([np.frombuffer(a, np.float64) for _, a in held]))
        held.clear()
        return pa.RecordBatch.from_pydict({"row": pa.array(rows), "add": pa.array(added), "contexts": pa.array(np.zeros(len(rows), np.int64))})

    for b in batches:
        for chunk, rows, adds, contexts in zip(*(b.column(c).to_pylist() for c in SUMS.names), strict=True):
            if held and chunk != last:
                yield out()
            last = chunk
            if rows is None:
                yield pa.RecordBatch.from_pydict({"row": pa.array([None], pa.int64()), "add": pa.array([None], pa.float64()), "contexts": pa.array([contexts], pa.int64())})
            else:
                held.append((rows, adds))
    if held:
        yield out()


def fit_and_score(docs: DataFrame, p_symbol: float = 1e-6, p_context: float = 0.0, depth: int = DEEPEST, min_gain: float = 6.0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Learn from the documents that are not held out, score all: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_contexts``; scores are sums of log10 probabilities over a text's words and its end.

    Contexts have up to ``depth`` words, three at most; with ``p_context`` only those that make up that share of the tokens
    are candidates. base_score is the smoothed word-frequency model's. Null text counts as empty: its end alone is scored.
    Rows that repeat count as often as they come and are scored each. A null id is not held out. Without any document to
    learn from, all words are unknown and share one probability. An empty table gives an empty result; other columns are
    not read. The driver and every worker hold the symbols: 1/p_symbol words of ``SYMBOL_BYTES`` bytes at most, 72 MB in all
    for a million.
    """
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"contexts have 1 to {DEEPEST} words")
    spark = docs.sparkSession
    for_python(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = stored(_counted(source.filter(~held_out("doc_id"))), "word_counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = int(sums["total"]), int(sums["distinct"])

    # At most 1 / p_symbol words of at most SYMBOL_BYTES bytes.
    common = (F.col("n") >= p_symbol * total) & (F.octet_length("word") <= SYMBOL_BYTES)
    listed = counts.filter(common).orderBy(F.desc("n"), "word").toArrow()
    each = np.array(listed.column("n").to_pylist(), np.int64)
    symbols = {bytes(w): i + 1 for i, w in enumerate(listed.column("word").to_pylist())}
    each = np.concatenate([[total - each.sum()], each]).astype(np.int64)
    if len(symbols) >= MASK:
        raise ValueError(f"{len(symbols)} symbols do not fit {BITS} bits")
    tree = SuffixTree(symbols, each, total, distinct, each >= max(1, p_context * total))
    sent = spark.sparkContext.broadcast(tree)
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))
    fields = {"row": T.LongType(), "doc_id": source.schema["doc_id"].dataType, "train": T.BooleanType(), "n_tokens": T.LongType(), "n_rare": T.LongType(), "base": T.DoubleType(), "score": T.DoubleType(), "ids": T.BinaryType(), "rare": rare}
    numbered = source.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), (~held_out("doc_id")).alias("train"))
    encoded = stored(_encoded(numbered, sent, T.StructType([T.StructField(c, t) for c, t in fields.items()])), "symbols")

    # What follows contexts with more tokens than a lane should have is counted beforehand, one length after the other.
    end = symbols.get(END, -1)  # which nothing follows
    deal = Lanes.over(np.where(np.arange(len(each)) == end, 0, each), int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables: list[DataFrame] = []
    for k in range(1, depth + 1):
        if not len(deal.hot[-1]):
            break
        runs = encoded.filter("train").select("ids").mapInArrow(_hot_runs(k, spark.sparkContext.broadcast(deal)), "bucket int, n int, codes binary")
        tables.append(stored(runs.repartition(deal.n, "bucket").sortWithinPartitions("bucket").mapInArrow(_hot_sums, "code long, n long"), f"runs_{k}"))
        if k < depth:  # at most as many as lanes
            more = tables[-1].filter((F.col("n") > deal.size) & (F.col("code").bitwiseAND(MASK) != end)).toArrow()
            code, n = more.column("code").to_numpy(), more.column("n").to_numpy()
            ctx = (code & MASK) << BITS * k | deal.hot[-1][code >> BITS]
            order = np.argsort(ctx)
            deal.hot.append(ctx[order])
            deal.whole.append(n[order])

    lanes = spark.sparkContext.broadcast(deal)
    judge = spark.sparkContext.broadcast(Judge(deal, tree.root, depth, p_context * total, min_gain))
    rows = [t.mapInArrow(_tree_rows(k, lanes), LANED) for k, t in enumerate(tables, 1)]
    rows.append(encoded.select("row", "ids", "train").mapInArrow(_token_rows(depth, lanes), LANED))
    found = reduce(DataFrame.unionByName, rows).repartition(deal.n, "lane").sortWithinPartitions("lane")
    sums = found.mapInArrow(_judged(judge), "chunk long, rows binary, adds binary, contexts long").repartition("chunk").sortWithinPartitions("chunk")
    added = stored(sums.mapInArrow(_by_text, "row long, add double, contexts long"), "added")
    dropped(spark, *tables)
    retained = added.agg(F.coalesce(F.sum("contexts"), F.lit(0))).first()[0]
    added = added.filter("row is not null").select("row", "add")

    # A rare word's share of its class; a word that was not learnt from counts as seen ADDED times.
    words_ = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("m"))
    shares = counts.filter(~common).select("word", F.log10(F.col("n") + ADDED).alias("share"))
    by_row = words_.join(shares, "word", "left").groupBy("row").agg(F.sum(F.col("m") * F.coalesce("share", F.lit(float(np.log10(ADDED))))).alias("rare_add"), F.sum(F.when(F.col("share").isNotNull(), F.col("m"))).alias("known"))
    out = encoded.drop("ids", "rare").join(added, "row", "left").join(by_row, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", (F.col("n_tokens") - F.col("n_rare") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_add")).alias("base_score"), (F.col("score") + zero("rare_add") + zero("add")).alias("score"), F.lit(retained).cast("long").alias("n_contexts"),
    )
