"""Runs that fail, stop and go on; scores of each kind; data sets on two components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.plans import landscape as L
from tesselar.plans import methods as M


@pytest.fixture(scope="module")
def samples(spark):
    def one(shift):
        points = spark.createDataFrame([(i, float(i % 6), float(i // 6), int(i % 6 > 2)) for i in range(36)], "i long, x double, y double, label int")
        v = spark.createDataFrame([(i, g, float((i % 6 > 2) * 5 * (g < 2) + (i * 7 + g + shift) % 3)) for i in range(36) for g in range(4)], "i long, gene int, v double")
        return {"points": points, "v": v, "truth": points.select("i", "label"), "true_markers": spark.range(2).select(F.col("id").cast("int").alias("gene")), "edges": M.get_method("neighborhood", "spatial_graph").run({"points": points}, k=4, mode="knn", radius=1.0)["edges"]}

    return {"a": one(0), "b": one(1)}


def plain(log):
    return sorted((r.dataset, r.category, r.method, r.status, r.score, (r.error or "")[:8]) for r in log.collect())


def test_stopped_and_resumed(spark, samples, tmp_path):
    tasks = {"spatially_variable_genes": ["spatial_variance_ratio", "gearys_c", "unheard_of"], "domain_detection": ["bisecting_kmeans"], "deconvolution": ["marker_deconv"]}
    whole = L.run_tasks(spark, samples, tasks, str(tmp_path / "whole"), {"a": {"n_domains": 2}, "b": {"n_domains": 2}})
    parts = str(tmp_path / "parts")
    for most in (1, 3, 0):
        L.run_tasks(spark, samples, tasks, parts, {"a": {"n_domains": 2}, "b": {"n_domains": 2}}, most=most)
    assert L.runs(spark, parts).count() == 4
    rest = L.run_tasks(spark, samples, tasks, parts, {"a": {"n_domains": 2}, "b": {"n_domains": 2}})
    assert plain(rest) == plain(whole) and whole.count() == 10
    by = {(d, m): (s, x, e) for d, _, m, s, x, e in plain(whole)}
    assert by["a", "spatial_variance_ratio"] == ("ok", 1.0, "") and by["a", "bisecting_kmeans"][0] == "ok" and by["a", "bisecting_kmeans"][1] is not None and by["b", "unheard_of"] == ("failed", None, "KeyError") and by["a", "marker_deconv"] == ("failed", None, "ValueErr")
    assert L.pending(spark, L.planned("ab", "spatially_variable_genes", ["unheard_of"]), parts).count() == 0
    assert L.pending(spark, L.planned("ab", "spatially_variable_genes", ["unheard_of"]), parts, ("failed",)).count() == 2
    best = {r.dataset: (r.config, r.niches) for r in L.winners(L.landscape(whole)).filter("category = 'spatially_variable_genes'").collect()}
    assert best["a"] == ("gearys_c", ["gearys_c", "spatial_variance_ratio"])


def test_a_job_that_raises_leaves_a_row(spark, samples, tmp_path):
    def broken(x):
        raise RuntimeError("no\nmore")

    m = M.register(M.Method("domain_detection", "broken_for_a_test", broken))
    try:
        log = L.run_tasks(spark, samples, {"domain_detection": ["broken_for_a_test", "bisecting_kmeans"]}, str(tmp_path))
        assert sorted((r.method, r.status, r.error) for r in log.collect())[2:] == [("broken_for_a_test", "failed", "RuntimeError: no")] * 2
    finally:
        del M.REGISTRY[m.category, m.name, m.version]


def test_nothing_ran_yet(spark, tmp_path):
    assert L.runs(spark, str(tmp_path / "none")).count() == 0 and L.winners(L.landscape(L.runs(spark, str(tmp_path / "none")))).count() == 0


def test_scores(spark, samples):
    p = spark.createDataFrame([(1, "t", 0.5), (1, "u", 0.5)], "i long, label string, p double")
    q = spark.createDataFrame([(1, "t", 0.7), (1, "u", 0.3)], "i long, label string, p double")
    assert L.scored({"true_proportions": p}, {"proportions": q}, "deconvolution") == pytest.approx(0.8)
    assert L.scored({}, {"proportions": q}, "deconvolution") is None and L.scored({}, {}, "qc") is None


def test_embedding(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 4))
    x[:, 3] = 2.0
    rows = [(f"d{i}", [None if (i, g) == (0, 0) else float("nan") if (i, g) == (1, 0) else float(v) for g, v in enumerate(r)]) for i, r in enumerate(x)]
    got = {r.dataset: (r.x, r.y) for r in L.embedded(spark.createDataFrame(rows, "dataset string, vec array<double>")).collect()}
    x[:2, 0] = np.median(x[2:, 0])
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = np.abs(u[:, :2] * s[:2])
    assert all(np.allclose(np.abs(got[f"d{i}"]), want[i]) for i in range(12))
    same = L.embedded(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "dataset string, vec array<double>")).collect()
    assert all((r.x, r.y) == (0.0, 0.0) for r in same)
