"""Knowledge bases written, read and refused; residuals of a dense matrix."""

import json

import numpy as np
import pytest

from tesselar.operators import normalize
from tesselar.sources import knowledge as K

ORDER = ["size", "depth"]


def base(spark, higher=True):
    scores = spark.createDataFrame([("a", "m", 0.9, 1.0), ("a", "n", 0.88, 2.0), ("b", "m", float("nan"), None), ("b", "n", 0.4, 3.0)], "dataset string, config string, score double, secs double")
    features = spark.createDataFrame([("a", [1.0, None]), ("b", [3.0, 4.0])], "dataset string, vec array<double>")
    meta = spark.createDataFrame([("a", {"platform": "visium"})], "dataset string, meta map<string,string>")
    return K.KnowledgeBase(scores, features, meta, ORDER, metric="ARI", higher_is_better=higher)


def plain(kb):
    return sorted(map(tuple, kb.scores.collect()), key=str), sorted(map(tuple, kb.features.collect())), sorted(map(tuple, kb.meta.collect()), key=str), kb.feature_order, kb.task, kb.metric, kb.higher_is_better


def test_roundtrip(spark, tmp_path):
    K.write(base(spark), str(tmp_path / "kb"))
    got = K.read(spark, str(tmp_path / "kb"))
    assert plain(got) == ([("a", "m", 0.9, 1.0), ("a", "n", 0.88, 2.0), ("b", "m", None, None), ("b", "n", 0.4, 3.0)], [("a", [1.0, None]), ("b", [3.0, 4.0])], [("a", {"platform": "visium"})], ORDER, "spatial_domain", "ARI", True)
    assert sorted(map(tuple, got.best().collect())) == [("a", "m", 0.9, ["m", "n"]), ("b", "n", 0.4, ["n"])]
    assert {r.dataset: r.config for r in base(spark, higher=False).best().collect()} == {"a": "n", "b": "n"}


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_document(spark, tmp_path, version):
    doc = {"schema_version": version, "task": "domain", "performance": {"a": {"m": 0.5, "n": None}, "b": {"m": 0.1}}, "features": {"a": [1, None], "b": [2, 3]}, "feature_order": ORDER, "timings": {"a": {"m": 2.5}}, "dataset_meta": {"b": {"platform": "xenium"}}}
    (tmp_path / "kb.json").write_text(json.dumps(doc, indent=1))
    if version == 4:
        with pytest.raises(ValueError, match="version"):
            K.read_document(spark, str(tmp_path / "kb.json"))
        return
    got = plain(K.read_document(spark, str(tmp_path / "kb.json")))
    assert got == ([("a", "m", 0.5, 2.5), ("a", "n", None, None), ("b", "m", 0.1, None)], [("a", [1.0, None]), ("b", [2.0, 3.0])], [("b", {"platform": "xenium"})], ORDER, "spatial_domain", "score", True)


def test_refused(spark, tmp_path):
    kb = base(spark)
    for change, said in (({"features": kb.features.filter("dataset = 'a'")}, "two data sets"), ({"feature_order": ["size"]}, "1 numbers"), ({"scores": kb.scores.selectExpr("dataset", "config", "double('nan') as score", "secs")}, "finite")):
        with pytest.raises(ValueError, match=said):
            K.KnowledgeBase(**{**kb.__dict__, **change}).checked()
    (tmp_path / "no.json").write_text("[1]")
    with pytest.raises(ValueError, match="object"):
        K.read_document(spark, str(tmp_path / "no.json"))


def test_pearson_residuals(spark):
    x = np.array([[3.0, 0, 1], [0, 0, 0], [5, 0, 2]])
    v = lambda m: spark.createDataFrame([(i, g, float(m[i, g])) for i in range(3) for g in range(3)], "i int, gene int, v double")
    mu = x.sum(1, keepdims=True) * (x.sum(0) + 1) / (x.sum() + 3)
    var = mu + mu**2 / 100
    want = np.clip(np.divide(x - mu, np.sqrt(var), out=np.zeros_like(x), where=var > 0), -10, 10)
    got = {(r.i, r.gene): r.v for r in normalize.pearson_residuals(v(x)).collect()}
    assert all(got[i, g] == pytest.approx(want[i, g]) for i in range(3) for g in range(3))
    assert {r.v for r in normalize.pearson_residuals(v(x * 0), gene_prior=0.0).collect()} == {0.0}
