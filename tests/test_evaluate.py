"""Evaluators and the failure atlas on hand-checked cases."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselar.operators import evaluate as V
from tesselar.operators import failures as X


def values(metrics):
    return {r.metric: r.value for r in metrics.collect()}


def test_fdr_control(spark):
    got = spark.createDataFrame([(0.0,), (0.05,), (0.525,), (1.0,)], "f double").select(V.fdr_control(F.col("f")).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([1, 1, 0.5, 0])


def test_matching_against_all_permutations():
    rng = random.Random(1)
    for n, m in ((3, 3), (2, 4), (4, 2), (1, 3)):
        iou = {(t, p): round(rng.random(), 3) for t in range(n) for p in range(m) if rng.random() < 0.7}
        if not iou:
            continue
        got = V._matched(pd.DataFrame([(t, p, x) for (t, p), x in iou.items()], columns=["t", "p", "iou"]))["iou"].sum()
        small, large = sorted((n, m))
        best = max(sum(iou.get((i, j) if n <= m else (j, i), 0) for i, j in enumerate(way)) for way in itertools.permutations(range(large), small))
        assert got == pytest.approx(best)


def test_segmentation(spark):
    pixels = [(1, 1)] * 6 + [(1, 2)] * 2 + [(2, 2)] * 2 + [(3, 0)] * 4 + [(0, 5)] * 3 + [(0, 0)] * 9
    got = values(V.segmentation(spark.createDataFrame(pixels, "truth int, pred int")))
    assert got["instance_ap50"] == 0.5
    assert got["mean_matched_iou"] == pytest.approx((6 / 8 + 2 / 4) / 3) and got["count_error"] == 0
    none = values(V.segmentation(spark.createDataFrame([(0, 0)], "truth int, pred int")))
    assert none == {"instance_ap50": 1, "mean_matched_iou": 0, "count_error": 0}


def test_annotation_and_domains(spark):
    obs = spark.createDataFrame([(0, "a", "a"), (1, "a", "a"), (2, "b", "a"), (3, "b", "b"), (4, "c", "d")], "i long, truth string, pred string")
    got = values(V.annotation(obs))
    assert got["macro_f1"] == pytest.approx((0.8 + 2 / 3 + 0 + 0) / 4) and got["balanced_accuracy"] == pytest.approx(0.5) and got["rare_type_recall"] == 0
    edges = spark.createDataFrame([(i, j) for i in range(5) for j in (i - 1, i + 1) if 0 <= j < 5], "i long, j long")
    same = values(V.domains(obs.withColumn("pred", F.col("truth")), edges))
    assert same == {"phenomenon_recovery": 1, "adjusted_rand_index": 1, "boundary_f1": 1}


def test_deconvolution_and_genes(spark):
    same = values(V.deconvolution(spark.createDataFrame([(i, k, x, x) for i in range(4) for k, x in (("a", 0.1 * i), ("b", 1 - 0.1 * i))], "i long, label string, p double, q double")))
    assert same == pytest.approx({"proportion_rmse": 0, "jensen_shannon_similarity": 1, "cell_type_correlation": 1})
    truth = spark.createDataFrame([(g, g < 2) for g in range(5)], "gene int, spatial boolean")
    got = values(V.variable_genes(spark.createDataFrame([(0, 0.9), (2, 0.8), (1, 0.1)], "gene int, score double"), truth))
    assert got == pytest.approx({"gene_pr_auc": (1 + 2 / 3) / 2, "precision_at_k": 0.5, "null_fdr_calibration": 1 - 0.45 / 0.95})


def test_neighbourhood_and_communication(spark):
    e = lambda rows: spark.createDataFrame(rows, "i long, j long")
    assert values(V.neighborhood(e([(1, 2), (2, 3)]), e([(2, 1), (1, 2), (3, 4)]))) == {"edge_f1": 0.5, "edge_precision": 0.5, "edge_recall": 0.5}
    assert values(V.neighborhood(e([(1, 2)]), e([]))) == {"edge_f1": 0, "edge_precision": 0, "edge_recall": 0}
    truth = spark.createDataFrame([("s", "t", "l", "r", True), ("s", "t", "l", "q", True), ("s", "t", "l", "x", False)], "source string, target string, ligand string, receptor string, active boolean")
    found = spark.createDataFrame([("s", "t", "l", "r", 1), ("s", "t", "l", "x", 2), ("s", "t", "l", "q", 3)], "source string, target string, ligand string, receptor string, rank int")
    assert values(V.communication(found, truth))["lr_precision_at_k"] == 0.5


def test_integration(spark):
    rng = random.Random(2)
    rows = [(i, [10.0 * (i % 2) + rng.random(), rng.random()]) for i in range(40)]
    obs = spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in range(40)], "i long, label int, batch int")
    got = values(V.integration(spark.createDataFrame(rows, "i long, vec array<double>"), obs, 4))
    assert got["biological_neighborhood_conservation"] == 1 and got["phenomenon_recoverability"] == 1 and got["batch_mixing"] > 0.7
    assert values(V.integration(spark.createDataFrame(rows, "i long, vec array<double>"), obs.withColumn("batch", F.lit(0)), 4))["batch_mixing"] == 1


def test_qc_and_signal(spark):
    n = 36
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "i long, j long")
    rng = random.Random(3)
    v = spark.createDataFrame([(i, g, float(i) if g == 0 else rng.random()) for i in range(n) for g in range(4)], "i long, gene int, v double")
    truth = spark.createDataFrame([(g, g == 0) for g in range(4)], "gene int, spatial boolean")
    assert V.signal_retention(v, v, edges, truth).first().signal == 1
    flat = v.withColumn("v", F.when(F.col("gene") == 0, 0.0).otherwise(F.col("v")))
    assert V.signal_retention(v, flat, edges, truth).first().signal < 0.6
    assert V.signal_retention(v, v.filter("i < 2"), edges, truth).first().signal == 0
    bad = spark.createDataFrame([(i, i < 6) for i in range(n)], "i long, bad boolean")
    got = values(V.qc(bad, bad.filter("i >= 6").select("i"), V.signal_retention(v, v, edges, truth)))
    assert got == {"qc_auprc": 1, "normal_retention": 1, "phenomenon_signal_retention": 1}


def profile(spark, pairs):
    return X.profiles(spark.createDataFrame([("m", "easy", 0, t, p) for t, p in pairs], "method string, condition string, run int, truth int, pred int")).first()


def test_failure_profiles(spark):
    good = profile(spark, [(i % 3, 7 + i % 3) for i in range(60)])
    assert (good.fragmentation, good.merge, good.noise, good.ari, good.fragmented, good.merged, good.noisy) == (0, 0, 0, 1, False, False, False)
    split = profile(spark, [(0, i % 6) for i in range(60)])
    assert split.fragmentation == 1 and split.fragmented and split.most_fragments == 6
    merged = profile(spark, [(i % 4, 0) for i in range(60)])
    assert merged.merge == 1 and merged.merged and merged.most_merged == 4
    crumbs = profile(spark, [(0, 0)] * 97 + [(0, 1), (0, 2), (0, 3)])
    assert crumbs.noisy and crumbs.n_micro == 3 and crumbs.noise == pytest.approx(0.75) and crumbs.micro_share == pytest.approx(0.03)


def test_structural_and_atlas(spark):
    cases = [(0.9, 0.1, 1.0), (0.6, 0.1, 0.0), (0.9, 0.95, 0.0), (0.9, 0.55, 0.5), (None, 0.5, 0.0)]
    got = spark.createDataFrame([c[:2] for c in cases], "e double, h double").select(X.structural(F.col("e"), F.col("h")).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([c[2] for c in cases])
    runs = [("good", c, r, i % 3, i % 3) for c in ("easy", "hard") for r in (0, 1) for i in range(30)]
    runs += [("falls", "easy", 0, i % 3, i % 3) for i in range(30)] + [("falls", "hard", 0, i % 3, i % 2) for i in range(30)] + [("only", "easy", 0, i % 3, 0) for i in range(30)]
    p = X.profiles(spark.createDataFrame(runs, "method string, condition string, run int, truth int, pred int"))
    a = {r.method: r for r in X.atlas(p).collect()}
    assert a["good"].dominant_mode == "none" and a["good"].n_evaluations == 2 and a["good"].n_failures == 0
    assert a["falls"].structural == 1 and a["falls"].ari_easy == 1 and a["falls"].n_failures == 1
    assert a["only"].n_evaluations == 1 and a["only"].ari_hard is None and a["only"].merge == 1 and a["only"].dominant_mode == "merge"
    assert {r.method for r in X.contributions(p).collect()} == {"good", "falls"}
