"""Rows that share an id or have none, with different texts: nothing that is found once is taken from any of them."""

import random

import corpus_pipeline as P
import pytest
from tesselar.llm.lines import drop_repeated_lines
from tesselar.llm.suffix_array import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def own(k, n=60):
    rng = random.Random(k)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_lines(spark):
    rows = [(i, f"boiler\nown {i}") for i in range(10)] + [(None, "boiler\nkeep a"), (None, "precious first line\nsecond"), (100, "boiler\nmine"), (100, "unique line A\nunique line B"), (100, "unique line A\nunique line B")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in drop_repeated_lines(frame(spark, rows)).collect())
    assert got == sorted([(i, f"own {i}") for i in range(10)] + [(-1, "keep a"), (-1, "precious first line\nsecond"), (100, "mine"), (100, "unique line A\nunique line B"), (100, "unique line A\nunique line B")])


def test_bytes(spark):
    a, b, passage = own(1), own(2, 3), own(3, 45)
    rows = [(1, passage), (5, a), (5, b + passage), (5, a), (7, a), (None, a), (None, b + passage)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.kept.decode()) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([(1, passage), (5, a), (5, b), (5, a), (7, ""), (-1, a), (-1, b + passage)])


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages(spark, name, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = [own(k) + "." for k in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (3, texts[4]), (None, None), (1, None), (4, "")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in dict(P.STAGES)[name](spark, frame(spark, rows), str(tmp_path)).collect())
    want = sorted((-1 if i is None else i, t or "") for i, t in rows if not (name == "near_dedup" and (i, t) == (2, texts[1])))
    assert got == want


def test_packing(spark):
    rows = [(1, "a b c"), (1, "d e"), (None, "f"), (None, "g h i"), (2, None)]
    pieces = P.packing(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_tokens for r in pieces) == sorted(r.length for r in pieces) and len(pieces) == 5
