"""Pages as token streams, and the streams as nested blocks: what the wrappers of ``wrappers`` are inferred from.

A stream has start and end tags, texts and nothing else: comments go, raw elements (scripts, titles) are one text. Reading
it closes what authors leave open (paragraphs, list items, cells) and skips end tags that close nothing. Inline elements
are no blocks: their text belongs to the block around them, ``br`` is white space in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

#: Elements that begin and end a block, fixed values of the language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is one text up to their end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: A start tag closes the open elements named here, as far as the nearest of those behind the bar.
_HEADINGS = "h1 h2 h3 h4 h5 h6"
CLOSES = {
    "li": ("li p", "ul ol menu dir"), "dd": ("dd dt p", "dl"), "dt": ("dd dt p", "dl"), "tr": ("tr td th p", "table"), "td": ("td th p", "tr table"), "th": ("td th p", "tr table"),
    "tbody": ("tbody thead tfoot tr td th p", "table"), "thead": ("tbody thead tfoot tr td th p", "table"), "tfoot": ("tbody thead tfoot tr td th p", "table"), "body": ("head title", "html"),
    **{h: (f"p {_HEADINGS}", "div article section td th li") for h in _HEADINGS.split()},
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SCOPES = frozenset("table td th caption".split())
IN_TABLES = frozenset("table tbody thead tfoot tr td th caption".split())
#: Blocks nested deeper are read as part of the block at this depth; their texts stay blocks of their own.
DEEPEST = 120
#: Words of class, id and role that are kept in a label.
WORDS = 8

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*"|=\s*+'[^']*'|[="'])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

Token = tuple[str, str, str]


def tokens(page: str) -> Iterator[Token]:
    """(kind, name or text, attributes) with kinds ``<``, ``>`` and ``#``; character references in texts are decoded."""
    at, n, m = 0, len(page), _TAG.search(page)
    while m:
        if m.start() > at:
            yield "#", html.unescape(page[at : m.start()]), ""
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if name and m[1]:
            yield ">", name, ""
        elif name:
            yield "<", name, m[3]
            if name in RAW:
                end = _END[name].search(page, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "#", page[at:stop], ""
                at = stop
                if not end:
                    yield ">", name, ""
                    return
        m = _TAG.search(page, at)
    if at < n:
        yield "#", html.unescape(page[at:]), ""


def label(name: str, attributes: str) -> str:
    """The element's name and the words of its class, id and role, without numbers."""
    if "=" not in attributes:
        return name
    found: dict[str, None] = {}
    for a in _ATTR.finditer(attributes):
        found.update(dict.fromkeys(_WORD.findall(_HUMP.sub(" ", html.unescape(a[2] or a[3] or a[4] or "")).lower())))
    return ".".join([name, *sorted(found)[:WORDS]])


class Block:
    """A block element: its label, and in page order its blocks and its runs of text as (text, characters in links)."""

    __slots__ = ("items", "label", "name")

    def __init__(self, label_: str):
        self.label, self.name, self.items = label_, label_.partition(".")[0], []


def blocks(page: str, dropped: frozenset[str], is_dropped: Callable[[str], bool]) -> Block:
    """The page's outermost block. Inline elements named in ``dropped``, or whose label ``is_dropped``, leave nothing."""
    root = Block("#page")
    stack: list[tuple[str, Block | None]] = [("#page", root)]  # open elements, with the block that takes their text
    run: list[str] = []
    links = hidden = in_link = 0

    def flush() -> None:
        nonlocal links
        if text := " ".join("".join(run).split()):
            next(b for _, b in reversed(stack) if b is not None).items.append((text, min(links, len(text))))
        run.clear()
        links = 0

    def pop(to: int) -> None:
        nonlocal hidden
        if any(b is not None for _, b in stack[to:]):
            flush()
        hidden -= sum(b is None for _, b in stack[to:])
        del stack[to:]

    def close(name: str, stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                return pop(i)
            if stack[i][0] in stop:
                break
        return None

    def shut_before(name: str) -> None:
        if name not in ("html", "body"):
            close("p", SCOPES)
        shut, stop = CLOSES.get(name, (frozenset(), frozenset()))
        for i in range(len(stack) - 1, 0, -1) if shut else ():
            other = stack[i][0]
            if other in shut:
                pop(i)
            elif other in stop or other in BLOCKS and name not in IN_TABLES:
                break

    for kind, x, attributes in tokens(page):
        if kind == "#":
            if not hidden:
                run.append(x)
                links += len(x) if in_link else 0
        elif kind == ">":
            in_link &= x != "a"
            close(x, frozenset() if x in IN_TABLES or x in ("body", "html") else SCOPES | {"ul", "ol"} if x == "li" else SCOPES)
        elif x in BLOCKS:
            shut_before(x)
            flush()
            in_link = 0
            if x == "hr" or x in ("html", "body") and any(name == x for name, _ in stack):
                continue
            above = next(b for _, b in reversed(stack) if b is not None)
            new = above
            if len(stack) <= DEEPEST:
                new = Block(label(x, attributes))
                above.items.append(new)
            stack.append((x, new))
        elif x == "br":
            if not hidden:
                run.append(" ")
        elif x in VOID or attributes.rstrip().endswith("/") and x not in RAW:
            continue
        elif x in dropped or is_dropped(label(x, attributes)):
            hidden += 1
            stack.append((x, None))
        elif x == "a":
            in_link = 1
    flush()
    return root
