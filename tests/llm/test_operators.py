"""Every operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tesselar.llm import queries as Q
from tesselar.llm import suffix_tree
from tesselar.llm.components import components
from tesselar.llm.exact import exact_dedup
from tesselar.llm.lines import LineRuns, drop_repeated_lines
from tesselar.llm.neardup import near_duplicates
from tesselar.llm.packing import Limits, Packer, Piece, pack
from tesselar.llm.pieces import encode_pieces
from tesselar.llm.pii import find_pii, mask_pii
from tesselar.llm import quality as K
from tesselar.llm.quality import fit_quality, score_fitted, score_quality
from tesselar.llm.suffix_array import common_prefixes, remove_repeats, suffix_array
from tesselar.llm.suffix_tree import SuffixTree, fit_and_score
from tesselar.llm.topk import top_k
from tests.parity import connect, same

DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def table(spark, texts, start=0):
    """Extra columns clash with names that the operators use inside."""
    rows = [(i + start, t, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, a int, key int").repartition(3)


def test_queries_with_sql(spark):
    con = connect(DIR)
    for name, sql in Q.ORACLES.items():
        same(Q.QUERIES[name](spark, DIR), con, sql)


def test_exact_dedup(spark):
    texts = ["a b", "ab", None, "", " \n", "A B", "é x", "éx ", "ab", "b a"] + ["copy"] * 50
    rows = exact_dedup(table(spark, texts), support=0.1).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(BLANK.sub("", t or ""), []).append(i)
    best = {k: min(v, key=lambda i: (-len(texts[i] or ""), i)) for k, v in groups.items()}
    for r in rows:
        k = BLANK.sub("", texts[r.doc_id] or "")
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best[k], len(groups[k]), best[k] == r.doc_id, hashlib.sha256(k.encode()).hexdigest())
    assert len(rows) == len(texts)
    assert exact_dedup(table(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "x"), (1, "x"), (None, "y"), (2, "z"), (2, "z")], "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:4]
    assert got == {(None, sha("x")): (1, 2, False), (1, sha("x")): (1, 2, True), (None, sha("y")): (None, 1, True), (2, sha("z")): (2, 2, True)}


def test_line_dedup(spark):
    random.seed(1)
    pool = [f"line {i}" for i in range(6)] + ["", "  ", "É", "é"]
    texts = [None, ""] + ["\n".join(random.choice(pool) + random.choice(["", " ", "\t"]) + random.choice(["", "u%d" % i]) for _ in range(random.randrange(1, 5))) for i in range(40)] + ["\n".join(["line 1"] * 1500 + ["LINE 2 ", "own"] * 3)]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = Counter(k for t in texts for k in {key(line) for line in (t or "").split("\n")} if k)
    rows = {r.doc_id: r for r in drop_repeated_lines(table(spark, texts), min_docs=5, batches=3).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < 5]
        assert (rows[i].text, rows[i].n_lines, rows[i].n_dropped, rows[i].n) == ("\n".join(kept), len(lines), len(lines) - len(kept), "x")
    assert drop_repeated_lines(table(spark, []), min_docs=2).count() == 0


def test_line_runs_meet_settled_runs(spark):
    """With the query's own batches later ones are anti-joined with settled runs, and levels are compacted."""
    texts = ["\n".join([f"w{i % 7}", f"x{i % 90}", f"own {i}", "everywhere"]) for i in range(400)]
    runs = LineRuns(spark, 10, fanout=2)
    rows = {r.doc_id: r for r in drop_repeated_lines(table(spark, texts), min_docs=10, runs=runs).collect()}
    assert runs.anti_joins >= 4 and runs.compactions >= 4 and len(runs.levels) >= 3 and not runs.tables
    assert all((r.text, r.n_dropped) == (f"x{i % 90}\nown {i}", 2) for i, r in rows.items())


CLASHES = ["_id", "_gone", "_both", "__doc", "__span", "__at", "__both", "__gone", "__was", "__stays", "__quality", "__pii", "_pii", "__scores", "n_lines", "__lines", "h1", "h2", "pos", "key", "__id", "__h1"]


def clashing(spark, texts):
    """Documents with columns named as those the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), *(f"{c} {i}" for c in CLASHES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "pii"])
def test_stages_keep_columns_of_any_name(spark, name, tmp_path):
    import corpus_pipeline as p

    random.seed(12)
    texts = [None, "", " \n ", "mail a@b.co now", "same words in here twice", "same words in here twice", "long " * 30_000] + [" ".join(f"w{random.randrange(9)}" for _ in range(9)) + "\nfoot" for _ in range(20)]
    docs = clashing(spark, texts)
    spark.createDataFrame([(i, i % 2, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(p.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert [r[c] for c in CLASHES] == [f"{c} {r.doc_id}" for c in CLASHES]
    text = {r.doc_id: r.text for r in rows}
    if name != "quality":
        assert text[0] is None and text[1] == ""
    if name == "line_dedup":
        assert not any("foot" in (t or "") for t in text.values()) and text[6] == texts[6]
    if name == "near_dedup":
        assert 4 in text and 5 not in text
    if name == "pii":
        assert text[3] == "mail [EMAIL] now" and set(text) == set(range(len(texts)))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_drop_repeated_lines_and_masks_keep_columns_of_any_name(spark):
    docs = clashing(spark, ["a\nb", "a\nc", None, "x@y.zz"])
    for out in (drop_repeated_lines(docs, min_docs=2, counts=("lines", "gone")), mask_pii(docs)):
        rows = out.collect()
        assert all([r[c] for c in CLASHES] == [f"{c} {r.doc_id}" for c in CLASHES] for r in rows) and len(rows) == 4


def test_pipeline_drops_boilerplate_pages(spark):
    """Pages of frequent lines only lose them; of ten equal texts one stays, empty lines inside or not."""
    import corpus_pipeline as p

    lines = ["Home", "All rights reserved.", "Contact us"]
    texts = [f"own {i}\n" + "\n".join(lines) for i in range(10)] + ["Contact us\nHome", "home \n\nAll rights reserved.", None]
    texts += ["First paragraph.\n\nSecond paragraph."] * 12 + ["first paragraph.\n \nSecond paragraph.\t", "one of its kind\nFirst paragraph."]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: (r.text, r.n_chars) for r in p.line_dedup(spark, docs, "").collect()}
    assert [got[i] for i in range(10)] == [(f"own {i}", 5) for i in range(10)]
    assert got[10] == ("", 0) and got[11] == ("", 0) and got[12] == (None, 0)
    assert got[13] == (texts[13], len(texts[13])) and all(not got[i][0].strip() for i in range(14, 26)) and got[26][0] == "one of its kind"


def luhn(d):
    return sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii(spark):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    good = {"email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")), "card": lambda m, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 8 <= len(d) <= 15}
    random.seed(5)
    texts = ["", None, "a@b.c%d@e.f x..@y.zz +1 (234) 567-8901 4111 1111 1111 1111x 1.2.3.4.5.6.7.8 999.1.1.1 000000255.1.1.1", "a." * 3000 + "@x.y", "1 " * 3000, "x@a" + ".b" * 9000, "+1" + "(" * 3000]
    texts += ["".join(random.choice("ab@.+-% 0123456789()é😀\n") for _ in range(300)) for _ in range(100)] + [" ".join(f"u{i}@m{i}.com +1 (555) 000-{1000 + i}" for i in range(400))]
    rows = {r.doc_id: r.pii for r in find_pii(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in pats.items() for m in re.finditer(p, t or "") if good[k](m.group(), re.sub("[^0-9]", "", m.group()))]
        assert [(s.kind, s.start, s.end) for s in rows[i] if s.kind in pats] == want
    more = table(spark, ["GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "my SSN is 123-45-6789", "no. 123-45-6789", "mail a@b.co, or a@b.co", None])
    assert [r.text for r in mask_pii(more).orderBy("doc_id").collect()] == ["[IBAN]", "GB83 WEST 1234 5698 7654 32", "my SSN is [SSN]", "no. 123-45-6789", "mail [EMAIL], or [EMAIL]", None]
    assert find_pii(table(spark, [])).count() == 0


HARD = ["", None, " ", "  ", "a", "a ", "  a  b\n\n  c", "▁x ▁▁ y", "<|endoftext|> <s> </s>", "x" * 3000, " " * 100, "\n" * 50, "é ü 漢字 😀 \x00 \x1c z　w\xa0q r", "don't we're 12,345.67 !!! foo_bar\tbaz\r\nqux"]


def hard_texts():
    random.seed(3)
    return HARD + ["".join(random.choice(" \n\t▁abcé1.'!漢😀\xa0\x1c\x85 ") for _ in range(150)) for _ in range(80)]


def test_packing(spark, tmp_path):
    from tokenizers import Tokenizer

    table(spark, hard_texts()).write.parquet(f"{tmp_path}/documents.parquet")
    tk = Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    for d in (str(tmp_path), DIR):
        docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        rows, by, seqs = Q.op2_vector_packing(spark, d).collect(), {}, {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
            seqs.setdefault(r.sequence_id, []).append(r)
        for i, t in docs.items():
            ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4")
            at = 0
            for r in sorted(by[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        for s in seqs.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024 and len(s) <= 256


@pytest.mark.parametrize("cut", [True, False])
def test_packer_keeps_all_limits(cut):
    random.seed(7)
    limits = Limits(tokens=40, segments=4, loss_tokens=25)
    packer, sequences, want = Packer(limits, cut, pool=16), [], {}
    for i in range(300):
        n = random.randrange(1, 60)
        want[i] = n
        sequences += packer.add(Piece(i, bytes(4 * n), 0, n, random.randrange(0, n + 1)))
    sequences += packer.fill()
    got = Counter()
    for s in sequences:
        assert s and sum(p.n for p in s) <= 40 and len(s) <= 4 and sum(p.loss for p in s) <= 25
        for p in s:
            got[p.key] += p.n
    assert got == want


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.vocabulary("piece_bpe_32k.model"))
    texts = hard_texts()
    rows = {r.doc_id: r for r in encode_pieces(table(spark, texts), Q.vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert rows[i].ids == ids and rows[i].decoded == sp.decode(ids)
    assert encode_pieces(table(spark, []), Q.vocabulary("piece_bpe_32k.model")).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vecs = [list(map(float, rng.normal(size=8))) for _ in range(300)]
    vecs[10], vecs[50], vecs[51], vecs[52] = vecs[11], None, [1.0, None] + [0.0] * 6, [float("nan")] * 8
    vecs[53], vecs[0] = [float("inf")] + [0.0] * 7, [3.0] * 8
    rows = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    got = {}
    for r in top_k(rows.filter("vec_id % 50 = 0"), rows, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [i for i, v in enumerate(vecs) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = {i: [math.floor(256 * x) for x in vecs[i]] for i in ok}
    assert set(got) == {i for i in ok if i % 50 == 0}
    for i, rs in got.items():
        want = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in ok if j != i))[:5]
        assert sorted(rs) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert top_k(rows.limit(0), rows.limit(0)).count() == 0
    assert [(r.query_id, r.vec_id) for r in top_k(rows.filter("vec_id = 1"), rows.filter("vec_id < 3 and vec_id > 0"), 5).collect()] == [(1, 2)]


def test_top_k_over_many_super_blocks(spark):
    """Vectors in clusters by id, with clashing columns and copies: bounds rule out most super-blocks, and no answer."""
    from tesselar.llm.topk import surviving

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    vecs = [(i, list(map(float, centres[i // 100] + rng.normal(size=8) * 0.1))) for i in range(1200)] + [(77, [4.0] * 8)] * 60 + [(5000 + i, [0.5] * 3) for i in range(3)]
    rows = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in vecs], "vec_id long, embedding array<double>, vec string, _s int, score double").repartition(4)
    asked = rows.filter("vec_id % 50 = 0")
    got = {}
    for r in top_k(asked, rows, 5, super_rows=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in vecs]
    want = {}
    for i, v in q:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i)[:5]
            want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {i: sorted(rs) for i, rs in got.items()} == want
    _, held, _, left = surviving(asked, rows, 5, super_rows=50)
    assert held.select("_s").distinct().count() > 10 and left.count() < 0.3 * len(want) * 25


def test_suffix_tree_base_and_mass(spark):
    random.seed(2)
    texts = [None, "", "  ", "A a É"] + [" ".join(random.choice("the cat sat on a mat and then some more".split()) for _ in range(random.randrange(0, 30))) for _ in range(60)] + ["w" * 70 + " rare"]
    rows = fit_and_score(table(spark, texts), p_symbol=0.05, p_context=0.02, min_gain=0.5).collect()
    toks = [[*WORDS.findall((t or "").translate(LOW)), None] for t in texts]
    train = Counter(w for i, ws in enumerate(toks) if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for r in rows:
        ws = toks[r.doc_id]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and rows[0].n_contexts > 0
    assert fit_and_score(table(spark, [])).count() == 0


def test_suffix_tree_probabilities_sum_to_one():
    random.seed(4)
    texts = [[random.choice([b"a", b"b", b"c", b"d"]) if random.random() < 0.5 else b"a" for _ in range(40)] for _ in range(50)]
    symbols = {b"a": 1, b"b": 2, b"": 3}
    counts = Counter(w if w in symbols else b"?" for ws in texts for w in (*ws, b""))
    each = np.array([counts[b"?"], counts[b"a"], counts[b"b"], counts[b""]])
    tree = SuffixTree(symbols, each, each.sum(), 5, each >= 1)
    for _ in range(2):
        codes, n = np.unique(tree.grams(texts), return_counts=True)
        tree.grow(codes, n, 0.1)
    for k, level in enumerate(tree.levels, 1):
        for ctx in range(len(level.count)):
            assert tree._prob(k, np.full(4, ctx), np.arange(4)).sum() == pytest.approx(1, abs=1e-9)


def test_suffix_tree_keeps_rare_contexts(spark):
    """The joined levels against the tree in memory, and a context too rare for a share of the corpus."""
    random.seed(6)
    texts = [" ".join(random.choice("a b c d e".split()) if random.random() < 0.6 else "a b" for _ in range(random.randrange(0, 40))) for _ in range(120)] + ["q r s t u"] * 12
    rows = fit_and_score(table(spark, texts), p_symbol=0.004, min_gain=0.5).collect()
    toks = [[x.encode() for x in WORDS.findall(t)] for t in texts]
    train = [ws for i, ws in enumerate(toks) if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for ws in train for w in (*ws, b""))
    total = sum(counts.values())
    symbols = {w: k + 1 for k, w in enumerate(w for w, n in counts.items() if n >= 0.004 * total)}
    each = np.array([total - sum(counts[w] for w in symbols), *(counts[w] for w in symbols)])
    tree = SuffixTree(symbols, each, total, len(counts), each >= 1)
    for _ in range(3):
        codes, n = np.unique(tree.grams(train), return_counts=True)
        tree.grow(codes[n >= 2], n[n >= 2], 0.5)
    assert rows[0].n_contexts == sum(int(x.retained.sum()) for x in tree.levels) and tree.levels[2].retained.any()
    for r in rows:
        ws = toks[r.doc_id]
        rare = sum(math.log10((counts[w] + 0.1) / tree.rare_whole) for w in ws if w not in symbols)
        assert r.score == pytest.approx(tree.log10(*tree.read([ws])).sum() + rare, rel=1e-9)
    filler = [" ".join(f"w{random.randrange(3000)}" for _ in range(2000)) for _ in range(150)]
    runs = {r.doc_id: r for r in fit_and_score(table(spark, ["q r s t u"] * 6 + filler)).collect()}
    assert runs[0].score > runs[0].base_score + 5  # 6 of 300,000 tokens are no share of the corpus


def test_suffix_tree_hot_contexts_have_lanes(spark, monkeypatch):
    """Words, pairs and triples with more tokens than a lane: the same scores, and transitions do not cross the shuffle as rows."""
    random.seed(8)
    texts = [" ".join(random.choice(["a b c", "a b", "a", f"w{random.randrange(400)}"]) for _ in range(random.randrange(0, 200))) for _ in range(300)]
    docs = table(spark, texts)
    plain = {r.doc_id: r for r in fit_and_score(docs).collect()}
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    begun = {stages().apply(i).stageId() for i in range(stages().size())}
    monkeypatch.setattr(suffix_tree, "LANE", 600)
    rows = fit_and_score(docs).collect()
    for r in rows:
        assert r.score == pytest.approx(plain[r.doc_id].score, rel=1e-9)
        assert (r.n_contexts, r.n_tokens) == (plain[r.doc_id].n_contexts, plain[r.doc_id].n_tokens)
    assert len(rows) == len(texts) and plain[0].n_contexts > 50
    found = stages()
    made = [found.apply(i) for i in range(found.size())]
    assert sum(x.shuffleWriteRecords() for x in made if x.stageId() not in begun) < sum(r.n_tokens for r in rows) / 3


def brute_near(texts, size, percent):
    sets = {}
    for i, t in enumerate(texts):
        ws = WORDS.findall((t or "").translate(LOW))
        sets[i] = {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    random.seed(4)
    base = [" ".join(f"w{random.randrange(500)}" for _ in range(random.randrange(30, 120))) for _ in range(8)]
    texts = ["", None, " ", "a", "A", "a b", "a b", "a b c", "A B  C", None]
    for _ in range(300):
        ws = random.choice(base).split()
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            ws[random.randrange(len(ws))] = f"z{random.randrange(99)}"
        texts.append(" ".join(ws))
    want = brute_near(texts, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table(spark, texts), 3, 85).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert near_duplicates(table(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(odd).collect()) == [(0, 0, True), (2, 2, True), (2, 2, True), (3, 2, False)]


@pytest.mark.parametrize("block", [3, 1500])
def test_near_duplicates_of_a_hot_key(spark, monkeypatch, block):
    """Chains of alike texts share keys but not all components: looked at again, by blocks of any size."""
    from tesselar.llm import neardup as N

    monkeypatch.setattr(N, "BLOCK", block)
    random.seed(14)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(140):
        ws = list(base)
        for at in random.sample(range(120), random.choice([1, 2, 3, 4, 5])):
            ws[at] = f"z{random.randrange(10_000)}"
        texts.append(" ".join(ws))
    want = brute_near(texts, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table(spark, texts), 3, 85).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()} and len({c for _, c in want.values()}) > 2


def test_signature_recall():
    """Of pairs at a threshold: the share that meet under a key and are within the accepted distance."""
    from tesselar.llm import neardup as N

    rng = np.random.default_rng(5)
    for share, least in ((0.85, 0.9999), (0.8, 0.9997)):
        differ = rng.random((200_000, N.CHUNKS, N.WIDTH)) >= share
        met = (differ.sum(2) <= N.ERRORS).any(1) & (differ.sum((1, 2)) <= N.ACCEPT)
        assert met.mean() >= least


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array_order():
    random.seed(2)
    for _ in range(150):
        al = random.choice([b"a", b"ab", b"abc\x00\xff"])
        d, depth = bytes(random.choice(al) for _ in range(random.randrange(0, 100))), random.choice([1, 3, 8, 20, 200])
        order = suffix_array(d, depth)
        assert sorted(order.tolist()) == list(range(len(d)))
        keys = [d[i : i + depth] for i in order]
        assert keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], common_prefixes(d, order, depth)[1:]):
            same_ = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert n == same_


def brute_repeats(texts, length=100):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(raw[k : k + length])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out.append((len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def test_remove_repeats_in_a_new_worker(tmp_path):
    """Nothing that the test session has imported is there."""
    code = """
from pyspark.sql import SparkSession
from tesselar.llm.suffix_array import remove_repeats
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", %r).getOrCreate()
text = "".join(chr(97 + i * i * 7 %% 26) + str(i) for i in range(60))
print("REMOVED", [(r.doc_id, r.n_removed) for r in remove_repeats(s.createDataFrame([(1, "x" + text), (2, "y" + text + "z"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()])
""" % str(tmp_path)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout
    n = sum(1 + len(str(i)) for i in range(60))
    assert f"REMOVED [(1, 0), (2, {n}), (3, 0)]" in out


@pytest.mark.parametrize("many", [3, 40, 20_000])
def test_remove_repeats_around_a_hot_anchor(spark, many):
    """One passage among ever different neighbours, and equal ones: by strings where it has too many surroundings to sort."""
    random.seed(8)
    passage = "the passage that all of them share, be it long or short, between two others"
    some = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    sides = [some(60) for _ in range(7)]
    texts = [random.choice([some(70), random.choice(sides)]) + passage + random.choice([some(70), random.choice(sides), ""]) for _ in range(150)]
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(table(spark, texts), many=many).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_repeats(texts)


def test_settled_by_batches_of_any_size():
    import pyarrow as pa
    from tesselar.llm import suffix_array as S

    random.seed(9)
    rows = sorted((random.randrange(12), random.randrange(6), random.randrange(2), random.randrange(30), random.randrange(9)) for _ in range(400))
    short = lambda h, s, t: (s % 3 << 32 | (s + t) % 4) + h * 0
    cols = [pa.array(c, pa.int64()) for c in zip(*((h, s, t, short(h, s, t), doc, a << 2 * S.PLACE | 100 << S.PLACE) for h, s, t, doc, a in rows))]
    whole, firsts, want = pa.RecordBatch.from_arrays(cols, names=S.NAMES), {}, set()
    for h, s, t, doc, a in rows:
        first = firsts.setdefault((h, s, t), (doc, a))
        if first != (doc, a):
            want |= {(doc, x) for x in range(a, a + 100)}
    by_h = {}
    for (h, s, t), (doc, a) in firsts.items():
        by_h.setdefault(h, []).append((short(h, s, t), doc, a))
    sort, hot = [], []
    for v in by_h.values():
        left, right = Counter(f >> 32 for f, _, _ in v), Counter(f & 0xFFFFFFFF for f, _, _ in v)
        for f, doc, a in v:
            kind = S.BEFORE * (f >> 32 > 0 and left[f >> 32] > 1) + S.BEHIND * (f & 0xFFFFFFFF > 0 and right[f & 0xFFFFFFFF] > 1)
            if len(v) > 9:
                hot.append((S.HOT, doc, a))
            elif kind:
                sort.append((kind, doc, a))
    assert sort and hot
    for size in (1, 3, 50, 400):
        sure, got = set(), []
        for b in S._settled(9)(whole.slice(i, min(size, 400 - i)) for i in range(0, 400, size)):
            for kind, doc, a, e in zip(*(c.to_pylist() for c in b.columns)):
                if kind == S.SURE:
                    sure |= {(doc, x) for x in range(a, e)}
                else:
                    got.append((kind, doc, a))
        assert sure == want and sorted(got) == sorted(sort + hot)


def test_remove_repeats(spark):
    random.seed(6)
    vocab = ["".join(random.choice("abcdeé") for _ in range(random.randrange(1, 9))) for _ in range(200)]
    some = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    passages = [some(random.randrange(15, 60)) for _ in range(8)]
    texts = ["", None, "a" * 99, "a" * 100, "a" * 1000, "b" * 101, "ab" * 300, "ab" * 300 + "c"]
    for _ in range(120):
        x = some(random.randrange(0, 30))
        for _ in range(random.randrange(0, 3)):
            p = random.choice(passages)
            x += p[random.randrange(len(p) // 2) :] + some(random.randrange(0, 20))
        texts.append(x)
    texts += texts[20:30]
    rows = {r.doc_id: r for r in remove_repeats(table(spark, texts)).collect()}
    rows = {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in rows.items()}
    assert [rows[i] for i in range(len(texts))] == brute_repeats(texts)
    assert remove_repeats(table(spark, [])).count() == 0


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(labels, "doc_id", "left_semi")
    trained = fit_quality(docs, labels.filter("doc_id % 4 <> 0"))
    assert min(trained.model.handed) > 0 and trained.model.rounds == 3
    rows = score_quality(docs.filter("doc_id % 4 = 0"), trained).join(labels, "doc_id").select("quality_scores.*", "quality", "toxic").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if r.quality == 0 or r.toxic == 1]
    assert sum(r.keep for r in good) >= 0.98 * len(good)
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_quality_views_teach_each_other(spark):
    """The query's counts, and its scores against a plain loop over all documents."""
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op1_cotraining(spark, d).collect()}
    one = next(iter(rows.values()))
    assert one.rounds == 3 and one.labels_by_content > 0 and one.labels_by_metadata > 0
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    labels = {r.doc_id: float(r.quality > 0 and r.toxic == 0) for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    feats = {r.doc_id: (K.content_features(r.text), K.metadata_features({"lang": r.lang, "source": r.source, "n_chars": r.n_chars})) for r in docs}
    assert len(labels) <= K.LABELLED
    order = sorted((i for i in labels if i in feats), key=lambda i: K.xxhash.xxh3_64_intdigest(feats[i][0].tobytes() + feats[i][1].tobytes() + np.float64(labels[i]).tobytes()))
    y = np.array([labels[i] for i in order])
    used = tuple(K.telling([feats[i][v] for i in order], y, K.TELLING[v]) for v in (0, 1))
    at = {i: tuple(K.placed(used[v], f[v]) for v in (0, 1)) for i, f in feats.items()}

    def taught(pool, rounds=3):
        learner = K.Learner(used, tuple([at[i][v] for i in order] for v in (0, 1)), y)
        given = set()
        for _ in range(rounds):
            model = learner.fitted()
            ps = model.score([x[0] for x in pool], [x[1] for x in pool])
            picked = []
            for v in (0, 1):
                for label in (0, 1):
                    best = {}
                    for x, p in zip(pool, ps[v] if label else 1 - ps[v]):
                        key = K.xxhash.xxh3_64_intdigest(x[0].tobytes() + b"|" + x[1].tobytes()) - 2**63
                        if p > (learner.share if label else 1 - learner.share) and (v, key) not in given:
                            best[key] = (-p, key, x)
                    picked += [(v, label, -p, key, x) for p, key, x in sorted(best.values(), key=lambda z: z[:2])[: learner.quota(label, K.QUOTA)]]
            for v, label, p, key, x in picked:
                learner.given.append(K.Handed(v, float(label), learner.weight(label, p), x))
                given.add((v, key))
        return learner.fitted(), learner

    pool = [at[i] for i in feats if i not in labels]
    model, learner = taught(pool)
    assert [sum(g.view == v for g in learner.given) for v in (0, 1)] == [one.labels_by_content, one.labels_by_metadata]
    for i, want in zip(feats, zip(*model.score([x[0] for x in at.values()], [x[1] for x in at.values()]))):
        assert (rows[i].content_score, rows[i].metadata_score, rows[i].score) == pytest.approx(want, abs=1e-9)
    # What one view sees of the pool changes what the other one learns.
    random.seed(1)
    for v in (0, 1):
        turned = [x[v] for x in pool]
        random.shuffle(turned)
        other, _ = taught([(t, x[1]) if v == 0 else (x[0], t) for t, x in zip(turned, pool)])
        assert np.abs(other.views[1 - v].weights - model.views[1 - v].weights).max() > 1e-6


def test_quality_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "s"), (None, "x y", "s"), (2, "", "s"), (3, "z " * 50_000, "t")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit_quality(docs, none).model is None
    assert [r.quality_scores.keep for r in score_quality(docs, fit_quality(docs, none)).collect()] == [True] * 5
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    trained = fit_quality(docs, some)
    assert score_quality(docs, trained).count() == 5 and score_quality(docs.limit(0), trained).count() == 0 and score_fitted(trained).count() == 5
    assert fit_quality(docs.limit(0), some).model is None


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in p.STAGES:
        new = stage(spark, docs, DIR)
        if name != "packing":
            assert new.columns == docs.columns
            assert new.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
            new.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
    assert docs.filter(docs.text.rlike(r"[a-z0-9]@[a-z0-9]+\.")).count() == 0
    tokens = {r.doc_id: r.n for r in new.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert set(tokens) == {r.doc_id for r in docs.collect()}


def test_packing_where_all_limits_bind(spark):
    """Conversations by turn: prompts bear no loss, and each of the three limits fills some sequences."""
    import tiktoken  # noqa: F401  the tables need it

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    pairs = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn)):
        if r.role == "assistant":
            pairs[f"{r.conv_id}:{r.turn}"] = (pairs.pop(r.conv_id, ""), r.text or "")
        else:
            pairs[r.conv_id] = pairs.get(r.conv_id, "") + (r.text or "") + "\n"
    rows = [(k, p + a, len(p)) for k, (p, a) in ((k, v) for k, v in pairs.items() if isinstance(v, tuple))]
    rows += [(f"short {i}", f"q{i} a", 3) for i in range(400)] + [(f"prompt {i}", "ask " * 150 + "yes", 599) for i in range(40)] + [("none", None, None)]
    limits = Limits(tokens=600, segments=24, loss_tokens=300)
    out = pack(spark.createDataFrame(rows, "id string, text string, prompt int").coalesce(1), Q.vocabulary("byte_bpe_50k.json"), limits, cut=True, prompt_col="prompt", id_col="id").collect()
    seqs, got = {}, Counter()
    for r in out:
        seqs.setdefault(r.sequence_id, []).append(r)
        got[r.doc_id] += r.length
    sums = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in seqs.values()]
    assert all(t <= 600 and n <= 24 and loss <= 300 for t, n, loss in sums)
    assert any(t == 600 and n < 24 and loss < 300 for t, n, loss in sums) and any(n == 24 and t < 600 and loss < 300 for t, n, loss in sums) and any(loss == 300 and t < 600 for t, n, loss in sums)
    assert set(got) == {k for k, _, _ in rows} and all(got[r.doc_id] == r.doc_tokens for r in out)
