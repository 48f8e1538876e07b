"""Wrappers and main texts: given pages against a plain reading of their one layout, made-up hosts against what was put in."""

import html
import random
import re

from tesselar.llm import wrappers as W
from tesselar.llm.markup import blocks, tokens
from tesselar.llm.wrappers import choose, expression, extract, infer, main_text, read

DIR = "/root/testdata/sf0.01"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def plainly(page):
    """The layout of the given pages: one article of a heading and paragraphs, in which b and br are the only tags."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    want = {r.page_id: (r.url, plainly(r.html), len(plainly(r.html))) for r in pages.collect()}
    got = extract(pages).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == want and len(got) == len(want)


def text(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def unnamed(rng, i):
    """A layout without any telling name: a menu, an advert now and then, the text, notes that are the same on all pages."""
    parts = [text(rng) for _ in range(rng.randrange(1, 9))]
    body = "".join(f"<p>{html.escape(p)}" + ("</p>" if rng.random() < 0.5 else "") for p in parts)
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in rng.sample(WORDS, 4))
    extra = f"<div><a href=x>{text(rng, 12)}</a></div>" if i % 3 else ""
    page = f"<html><body><div id=h><b>The Site</b></div><ul>{menu}</ul>{extra}<div class=c1><h2>Title {i}</h2>{body}<table><tr><td>cell {i}<td>other {i}</table></div><div>All rights reserved by the site, whoever reads it.</div>"
    return page, "\n".join([f"Title {i}", *parts, f"cell {i}", f"other {i}"])


def named(rng, i):
    parts = [text(rng) for _ in range(rng.randrange(1, 5))]
    noise = f"<aside>{text(rng)}</aside><div class='cookie-notice'>{text(rng)}</div><form><p>{text(rng)}</p></form><section id=comments><article><p>{text(rng)}</p></article></section>"
    page = f"<header>{text(rng)}</header><main><article class=post><header><h1>A &amp; B {i}</h1></header>" + "".join(f"<p>{p}<br>\n<i>more</i>&nbsp;</p><div class=ad-slot>{text(rng)}</div>" for p in parts) + f"<script>if(a<b){{'</p>'}}</script><!-- x > y --></article></main>{noise}<footer>{text(rng)}</footer>"
    return page, "\n".join([f"A & B {i}", *(f"{p} more" for p in parts)])


def made(seed=1, n=24):
    rng = random.Random(seed)
    rows, want = [], {}
    for k, (host, layout) in enumerate({"plain.example": unnamed, "named.example": named}.items()):
        for i in range(n):
            page, t = layout(rng, i)
            rows.append((1000 * k + i, f"HTTP://u@{host.upper()}:80/{i}" if i % 2 else f"http://{host}/{i}?q#f", page))
            want[1000 * k + i] = t
    return rows, want


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "page_id long, url string, html string, text string, pages int, host string, wrapper int")


def test_layouts(spark):
    rows, want = made()
    for n in (1, 5):
        got = {r.page_id: r.text for r in extract(frame(spark, rows).repartition(n)).collect()}
        assert got == want


def test_edges(spark):
    long = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "".join(f"<p>p {i}" for i in range(20_000)) + "</article>"
    odd = {
        1: (None, ""), 2: ("", ""), 3: ("<p>only text", "only text"), 4: ("<article>", ""), 5: (long, "deep\n" + "\n".join(f"p {i}" for i in range(20_000))), 6: ("just words &lt;b&gt; &am", "just words <b> &am"),
        7: ("<article>a <b>b<p>c</b> d<div class=sidebar>no</div>e</article", "a b\nc d\ne"), 8: ("<!--", ""), 9: ("<article><p>a <x y='>'>b</x> <script>c", "a b"), 10: ("<nav>x</nav><style>p</style>", ""), 11: ("<article><p>a <x y=\"b>c", "a c"),
    }
    rows = [(i, f"http://h{i}.example/", page) for i, (page, _) in odd.items()] + [(None, None, "<article>none</article>"), (20, None, "<article>none</article>"), (20, None, "<article>none</article>")]
    got = extract(frame(spark, rows)).collect()
    assert {r.page_id: r.text for r in got if r.page_id and r.page_id < 20} == {i: t for i, (_, t) in odd.items()}
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got if (r.page_id or 20) == 20) == [(0, None, "none", 4), (20, None, "none", 4), (20, None, "none", 4)]
    assert extract(frame(spark, [])).count() == 0


def test_wrappers_are_the_same_however_pages_are_dealt(spark):
    rows, _ = made(2)
    found = [sorted((r.host, r.pages, W._unpacked(r.wrapper).pattern()) for r in infer(frame(spark, rows).repartition(n)).collect()) for n in (1, 7)]
    assert found[0] == found[1] and [x[:2] for x in found[0]] == [("named.example", 24), ("plain.example", 24)]


def test_expressions():
    page = expression(read("<body><ul><li>a<li>b</ul><h2>t</h2><p>x<p>y<h2>u</h2><p>z"))
    assert page.pattern() == "<#page><body><ul><li>#text</>+</> (<h2>#text</> <p>#text</>+)+</></>"
    other = expression(read("<body><h2>t</h2><p>x</p><div>n</div>"))
    assert "<div>#text</>?" in W._merged(page, other).pattern() and "<ul>" in W._merged(page, other).pattern()
    same = W._merged(expression(read("<body><p>same")), expression(read("<body><p>same")))
    assert same.pattern() == "<#page><body><p>#text</></></>"


def test_size_is_bounded():
    rng, wrapper = random.Random(5), None
    for i in range(150):
        page = "".join(f"<{t} class=k{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}>x" for t in rng.choices("div p section h2 h3 pre ul".split(), k=rng.randrange(60)))
        x = expression(read("<body>" + page))
        wrapper = x if wrapper is None else W._merged(wrapper, x)
    assert wrapper.pages == 150 and max(len(x.items) for x in W._everywhere(wrapper)) <= 2 * W.LONGEST


def test_tokens_and_blocks():
    assert list(tokens("a<b c='>'>d</b><!-- <p> -->e<script>1<2</scr</script>&lt;")) == [("#", "a", ""), ("<", "b", " c='>'"), ("#", "d", ""), (">", "b", ""), ("#", "e", ""), ("<", "script", ""), ("#", "1<2</scr", ""), (">", "script", ""), ("#", "<", "")]
    root = blocks("<table><tr><td>a<div>b<td>c<tr><td>d</table><p>e <a href=x>f</a> g<p>h", frozenset(), lambda _: False)

    def plain(b):
        return [b.label, *(plain(x) if not isinstance(x, tuple) else x for x in b.items)]

    assert plain(root) == ["#page", ["table", ["tr", ["td", ("a", 0), ["div", ("b", 0)]], ["td", ("c", 0)]], ["tr", ["td", ("d", 0)]]], ["p", ("e f g", 1)], ["p", ("h", 0)]]


def test_own_wrapper_where_the_host_has_none():
    assert main_text("<body><div><p>a b c d e f</p><p>g h i j k</p></div><div><a>m</a></div>", None) == "a b c d e f\ng h i j k"
    w = choose(expression(read("<article>x</article>")))
    assert main_text("<body><p>a page of another kind", w) == "a page of another kind"
