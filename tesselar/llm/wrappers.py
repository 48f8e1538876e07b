"""Main texts of pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream is read as nested blocks (``markup``), and a wrapper is an expression over the same: a sequence of
items, each a block with a sequence of its own, a text, or a group, and each of them needed, optional or repeated. Equal
neighbours and runs that come twice in a row become repeated items; then wrapper and page are aligned, sequence by
sequence. Texts that differ become slots. A mismatch becomes an optional item; where one label stands a third time in a
sequence, what lies between becomes a repeated group of optional items, so a wrapper's size does not grow with the pages.

Every item counts its pages, its characters and those in links. From these the host's main region is chosen: its article,
or, without one, the block below which most of the characters in slots lie, less what is the same text on all pages or
mostly links. A page is then aligned with its host's wrapper, and the texts that fall into the region come out.

Pages of a host with equal streams are merged where they are read, so a host sends no more than one row for each task and
stream; streams are dealt by hash, merged in their order, and what is left of a host is 16 rows. Merging adds numbers and
goes by that fixed order, so results do not depend on how the table is dealt.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, met_by_weight, stored
from .markup import Block, blocks

#: Elements whose content is no text of the article, inline ones and blocks.
INLINE_DROPPED = frozenset("script style template noscript title button select textarea svg math iframe object canvas audio video datalist xmp noembed noframes".split())
BLOCKS_DROPPED = frozenset("head nav footer aside form menu dialog header search".split())
#: Words of class, id or role that name what is not the article.
NAMED = frozenset(
    "ad ads advert advertisement adverts advertising adbox sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert sidebar aside rail comment comments disqus reply replies respond "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar share sharing social related recommended newsletter subscribe signup popup modal overlay toolbar login search".split()
)
ARTICLES = frozenset(("article", "main"))
#: Words that name the article where no element does.
NAMED_ARTICLE = frozenset(("main", "articlebody"))
#: Blocks that hold one piece of text.
TEXTS = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre #".split())
#: Items of a sequence; beyond it the sequence becomes one group, whose labels are names alone.
LONGEST = 40
#: Pages from which a text that is the same on all of them is the template's.
SURE = 3
#: Share of a region's characters below which no child is the region; share of characters in links from which a block is a menu.
DOMINANT, LINKED = 0.6, 0.5
SALTS = 16
SLOT = -1


def _name(label: str) -> str:
    return label.partition(".")[0]


@lru_cache(maxsize=50_000)
def _words(label: str) -> frozenset[str]:
    return frozenset(label.split(".")[1:])


def named_away(label: str) -> bool:
    """Its class, id or role says that it is not the article's."""
    return _name(label) not in ("html", "body", "main", "#page") and bool(_words(label) & NAMED)


class Item:
    """One item of a wrapper. ``const``: hash of the text that all pages have there, or SLOT; ``role`` is set by ``choose``."""

    __slots__ = ("chars", "const", "items", "label", "links", "many", "may", "pages", "role")

    def __init__(self, label: str, items: list[Item], chars: int = 0, links: int = 0, const: int = 0, many: bool = False, may: bool = False, pages: int = 1):
        self.label, self.items, self.chars, self.links, self.const, self.many, self.may, self.pages, self.role = label, items, chars, links, const, many, may, pages, ""

    def plain(self) -> list:
        return [self.label, [x.plain() for x in self.items], self.chars, self.links, self.const, int(self.many), int(self.may), self.pages]

    @classmethod
    def of(cls, plain: list) -> Item:
        label, items, chars, links, const, many, may, pages = plain
        return cls(label, [cls.of(x) for x in items], chars, links, const, bool(many), bool(may), pages)

    def shape(self) -> str:
        return f"{self.label}{'*' if self.many else ''}{'?' if self.may else ''}({' '.join(x.shape() for x in self.items)})"

    def pattern(self) -> str:
        """The expression as text, for people."""
        mark = "*" if self.many and self.may else "+" if self.many else "?" if self.may else ""
        inner = " ".join(x.pattern() for x in self.items)
        if self.label == "#":
            return ("#slot" if self.const == SLOT else "#text") + mark
        return f"({inner}){mark}" if self.label == "(" else f"<{self.label}>{inner}</>{mark}"


def _merged(a: Item, b: Item, side_by_side: bool = False, repeated: bool | None = None) -> Item:
    """One item for both: of two pages, or of neighbours in one page, which make a repeated item (what they hold does not)."""
    const = a.const if a.const == b.const else SLOT
    if side_by_side:
        const = SLOT if SLOT in (a.const, b.const) else xxhash.xxh3_64_intdigest(f"{a.const} {b.const}") >> 1
    pages = max(a.pages, b.pages) if side_by_side else a.pages + b.pages
    return Item(a.label, aligned(a.items, b.items, side_by_side), a.chars + b.chars, a.links + b.links, const, a.many or b.many or (side_by_side if repeated is None else repeated), a.may or b.may, pages)


def _alike(a: Item, b: Item) -> bool:
    """Neighbours that are one item repeated: same label, and blocks that hold blocks have the same kinds of them."""
    if a.label != b.label:
        return False
    if _name(a.label) in TEXTS:
        return True
    x, y = {i.label for i in a.items}, {i.label for i in b.items}
    return 2 * len(x & y) >= len(x | y)


def _inner(x: Item) -> list[Item]:
    return x.items if x.label == "(" else [x]


def _group(items: list[Item], side_by_side: bool) -> Item:
    """A repeated group of optional items, one for each label, that stands for all ``items``."""
    found: dict[str, Item] = {}
    for x in (y for x in items for y in _inner(x)):
        found[x.label] = _merged(found[x.label], x, side_by_side) if x.label in found else x
    if len(found) > LONGEST:
        short: dict[str, Item] = {}
        for x in found.values():
            name = _name(x.label)
            x = Item(name, x.items, x.chars, x.links, x.const, x.many, x.may, x.pages)
            short[name] = _merged(short[name], x, side_by_side) if name in short else x
        found = short
    for x in found.values():
        x.may = True
    return Item("(", list(found.values()), many=True, pages=max(x.pages for x in items), const=SLOT)


def _bounded(items: list[Item], side_by_side: bool) -> list[Item]:
    """The sequence with a repeated group in place of what lies between the first and the last of three equal labels."""
    while True:
        places: dict[str, list[int]] = {}
        for i, x in enumerate(items):
            for y in _inner(x):
                places.setdefault(y.label, []).append(i)
        often = [p for p in places.values() if len(p) > 2]
        if often:
            a, b = min(p[0] for p in often), max(p[-1] for p in often)
        elif len(items) > LONGEST:
            a, b = 0, len(items) - 1
        else:
            return items
        items = [*items[:a], _group(items[a : b + 1], side_by_side), *items[b + 1 :]]


def folded(items: list[Item]) -> list[Item]:
    """A page's sequence with repeats as repeated items: equal neighbours, then runs of two to four that come again."""
    out: list[Item] = []
    for x in items:
        if out and _alike(out[-1], x):
            out[-1] = _merged(out[-1], x, True)
        else:
            out.append(x)
    for period in (2, 3, 4):
        i = 0
        while i + 2 * period <= len(out):
            n = 1
            while [x.label for x in out[i : i + period]] == [x.label for x in out[i + n * period : i + (n + 1) * period]]:
                n += 1
            if n > 1 and "(" not in {x.label for x in out[i : i + period]}:
                run = out[i : i + period]
                for k in range(1, n):
                    run = [_merged(a, b, True, False) for a, b in zip(run, out[i + k * period : i + (k + 1) * period], strict=True)]
                out[i : i + n * period] = [Item("(", run, many=True, const=SLOT)]
            i += 1
    return _bounded(out, True)


def _score(a: Item, b: Item) -> float:
    """What it is worth to take both for one item; 0 where they can't be."""
    if a.label == "(" or b.label == "(":
        return 1.0 if {x.label for x in _inner(a)} & {x.label for x in _inner(b)} else 0.0
    if a.label != b.label:
        return 0.0
    x, y = {i.label for i in a.items}, {i.label for i in b.items}
    return 1.0 + (len(x & y) / len(x | y) if x or y else float(a.const == b.const))


def _paired(a: list[Item], b: list[Item], score: Callable[[Item, Item], float]) -> list[tuple[int, int]]:
    """The best alignment in order: pairs of places that are taken for one."""
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            s = score(a[i], b[j])
            row[j] = max(below[j], row[j + 1], below[j + 1] + s if s else 0.0)
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        s = score(a[i], b[j])
        if s and best[i][j] == best[i + 1][j + 1] + s:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def aligned(a: list[Item], b: list[Item], side_by_side: bool = False) -> list[Item]:
    """One sequence for both: what matches is merged, what does not becomes optional."""
    if [x.label for x in a] == [x.label for x in b] and "(" not in {x.label for x in a}:
        return [_merged(x, y, side_by_side, False) for x, y in zip(a, b, strict=True)]
    out: list[Item] = []
    i = j = 0
    for p, q in [*_paired(a, b, _score), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            x.may = True
            out.append(x)
        if p < len(a):
            x, y = a[p], b[q]
            out.append(_merged(x, y, side_by_side, False) if "(" not in (x.label, y.label) else _group([x, y], side_by_side))
        i, j = p + 1, q + 1
    return _bounded(out, side_by_side)


def read(page: str | None) -> Block:
    return blocks(page or "", INLINE_DROPPED, named_away)


def expression(block: Block) -> Item:
    """One page's own wrapper."""
    items = [expression(x) if isinstance(x, Block) else Item("#", [], len(x[0]), x[1], xxhash.xxh3_64_intdigest(x[0]) >> 1) for x in block.items]
    items = folded(items)
    return Item(block.label, items, sum(x.chars for x in items), sum(x.links for x in items), SLOT)


def _everywhere(x: Item) -> list[Item]:
    return [x, *(z for y in x.items for z in _everywhere(y))]


def _away(label: str, inside: bool) -> bool:
    """Not the article's; inside of it a header is."""
    return _name(label) in BLOCKS_DROPPED and not (inside and _name(label) == "header") or named_away(label) and not (inside and _name(label) == "header")


def _articles(x: Item, strict: bool) -> list[Item]:
    if strict and _away(x.label, False):
        return []
    if (_name(x.label) == "article" or _words(x.label) & NAMED_ARTICLE or _name(x.label) == "main") and x.chars:
        inner = [z for y in x.items for z in _articles(y, strict)]
        return inner if _name(x.label) == "main" and any(_name(y.label) == "article" for y in inner) else [x]
    return [z for y in x.items for z in _articles(y, strict)]


def _mass(x: Item) -> int:
    """Characters that tell pages apart, out of links."""
    if _away(x.label, False):
        return 0
    if x.label == "#":
        return 0 if x.const != SLOT and x.pages >= SURE else max(0, x.chars - x.links)
    return sum(map(_mass, x.items))


def choose(wrapper: Item) -> Item:
    """Sets ``role``: ``main`` where the region is, ``drop`` on what is left out of one that was found by its characters."""
    found = _articles(wrapper, True) or _articles(wrapper, False)
    for x in found:
        x.role = "main"
    at = wrapper
    while not found and at.items:
        masses = [_mass(x) for x in at.items]
        k = max(range(len(masses)), key=masses.__getitem__)
        if not masses[k] or masses[k] < DOMINANT * sum(masses) or _name(at.items[k].label) in TEXTS or at.items[k].label == "(" and at.label not in ("#page", "html"):
            break
        at = at.items[k]
    if not found:
        at.role = "main"
        for x in _everywhere(at):
            same = x.label == "#" and x.const != SLOT and x.pages >= SURE
            menu = x.label not in ("#", "(") and x is not at and x.links > LINKED * x.chars
            x.role = x.role or ("drop" if same or menu else "")
    return wrapper


def _runs(items: list) -> list[tuple[str, list]]:
    """A page's sequence as runs of one label."""
    out: list[tuple[str, list]] = []
    for x in items:
        label = x.label if isinstance(x, Block) else "#"
        if out and out[-1][0] == label and _name(label) in TEXTS:
            out[-1][1].append(x)
        else:
            out.append((label, [x]))
    return out


def _place(items: list, wrapper: list[Item]) -> list[tuple[object, Item | None]]:
    """Every item of a page's sequence with the wrapper's that it falls on."""
    runs, flat = _runs(items), [(y, k) for k, x in enumerate(wrapper) for y in _inner(x)]
    labels, names = {}, {}
    for y, k in flat:
        labels.setdefault(y.label, []).append(k)
        names.setdefault(_name(y.label), []).append(k)

    def fits(label: str, x: Item) -> float:
        for y in _inner(x):
            if y.label == label:
                return 2.0
        return 1.0 if any(y.label == _name(label) for y in _inner(x)) else 0.0

    # As in an alignment, but a repeated item takes any number of runs.
    n, m = len(runs), len(wrapper)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            s = fits(runs[i][0], wrapper[j])
            best[i][j] = max(best[i + 1][j], best[i][j + 1], s + best[i + 1][j if wrapper[j].many else j + 1] if s else 0.0)
    out: list[tuple[object, Item | None]] = []
    i = j = 0
    while i < n:
        s = fits(runs[i][0], wrapper[j]) if j < m else 0.0
        to = j if j < m and wrapper[j].many else j + 1
        if s and best[i][j] == s + best[i + 1][to]:
            own = next((y for y in _inner(wrapper[j]) if y.label == runs[i][0]), None) or next(y for y in _inner(wrapper[j]) if y.label == _name(runs[i][0]))
            out += [(x, own) for x in runs[i][1]]
            i, j = i + 1, to
        elif j < m and best[i][j] == best[i][j + 1]:
            j += 1
        else:
            out += [(x, None) for x in runs[i][1]]
            i += 1
    return out


def _texts(block: Block, item: Item | None, inside: bool, out: list[str]) -> bool:
    """Append the texts of the region in page order; whether the page has the region."""
    met = inside
    for x, own in _place(block.items, item.items) if item is not None else [(x, None) for x in block.items]:
        role = own.role if own is not None else ""
        if not isinstance(x, Block):
            if inside and role != "drop":
                out.append(x[0])
            continue
        if role == "main":
            met = _texts(x, own, True, out) or met
        elif inside:
            if role != "drop" and not _away(x.label, _holds_title(x)):
                _texts(x, own, True, out)
        elif own is not None:
            met = _texts(x, own, False, out) or met
    return met


def _holds_title(block: Block) -> bool:
    """A header in an article that has the article's title."""
    return block.name == "header" and any(isinstance(x, Block) and (x.name == "h1" or _holds_title(x) or x.name in ("div", "hgroup") and any(isinstance(y, Block) and y.name == "h1" for y in x.items)) for x in block.items)


def main_text(page: str | None, wrapper: Item | None) -> str:
    """The texts of a page's blocks in the region that its host's wrapper names; a page that the wrapper does not reach is
    taken as its own."""
    block = read(page)
    for w in (wrapper, None):
        w = w or choose(expression(block))
        out: list[str] = []
        if _texts(block, w, w.role == "main", out) and out:
            return "\n".join(out)
    return ""


PARTIAL = "host string, salt int, shape long, pages long, wrapper binary"


def _packed(x: Item) -> bytes:
    return zlib.compress(json.dumps(x.plain(), separators=(",", ":")).encode(), 1)


def _unpacked(raw: bytes) -> Item:
    return Item.of(json.loads(zlib.decompress(raw)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PARTIAL.split(", ")])


def _inferred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's pages one wrapper for each host and stream."""
    held: dict[tuple[str, int], Item] = {}
    size = 0

    def out() -> pa.RecordBatch:
        made = _batch([(host, shape % SALTS, shape, x.pages, _packed(x)) for (host, shape), x in held.items()])
        held.clear()
        return made

    for b in batches:
        for host, page in zip(b.column("__host").to_pylist(), b.column("html").to_pylist(), strict=True):
            x = expression(read(page))
            shape = x.shape()
            key = host, xxhash.xxh3_64_intdigest(shape) >> 1
            held[key] = _merged(held[key], x) if key in held else x
            size += len(shape)
            if len(held) > 5_000 or size > 20_000_000:
                yield out()
                size = 0
    if held:
        yield out()


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of host and salt: one for each. Holds one wrapper."""
    key, wrapper, pages, made = None, None, 0, []
    for b in batches:
        for host, salt, n, raw in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "pages", "wrapper")), strict=True):
            x = _unpacked(raw)
            if wrapper is not None and key != (host, salt):
                made.append((*key, 0, pages, _packed(wrapper)))
                wrapper, pages = None, 0
                if len(made) >= 500:
                    yield _batch(made)
                    made = []
            key, wrapper, pages = (host, salt), x if wrapper is None else _merged(wrapper, x), pages + n
    if wrapper is not None:
        made.append((*key, 0, pages, _packed(wrapper)))
    if made:
        yield _batch(made)


def host_of(url: Column) -> Column:
    """The URL's host in lower case; '' for all that have none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, pages, wrapper): of every host its wrapper, packed. No task holds more than one task's streams or one wrapper."""
    for_python(pages.sparkSession)
    source = pages.select(host_of(F.col(url_col)).alias("__host"), F.col(html_col).alias("html"))
    partial = source.mapInArrow(_inferred, PARTIAL)
    first = partial.repartition("host", "salt").sortWithinPartitions("host", "salt", "shape").mapInArrow(_combined, PARTIAL)
    whole = first.withColumn("shape", F.col("salt").cast("long")).withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "shape").mapInArrow(_combined, PARTIAL)
    return whole.select("host", "pages", "wrapper")


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(maxsize=500)
    def chosen(raw: bytes) -> Item:
        return choose(_unpacked(raw))

    for b in batches:
        texts = [main_text(page, chosen(raw) if raw is not None else None) for page, raw in zip(b.column("__html").to_pylist(), b.column("__wrapper").to_pylist(), strict=True)]
        own = [i for i, n in enumerate(b.schema.names) if not n.startswith("__")]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in own), pa.array(texts, pa.string())], names=[*(b.schema.names[i] for i in own), "text"])


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars``.

    ``text`` has the blocks of the page's main region in page order, one to a line, white space in a block as one space;
    it is empty where there is none. A null or empty page has none; pages without a host, or with a null URL, share a
    wrapper. Rows that repeat count as pages each and come out each. Pages may have any length; one lies in memory at a
    time. An empty table gives an empty result; other columns are not read.
    """
    wrappers = stored(infer(pages, html_col, url_col), "wrappers")
    total = wrappers.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("__html"), host_of(F.col(url_col)).alias("host"))
    met = met_by_weight(rows, wrappers.withColumnRenamed("wrapper", "__wrapper"), "host", "pages", max(1, total)).drop("host")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = met.mapInArrow(_extracted, f"page_id {types['page_id']}, url {types['url']}, text string")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
