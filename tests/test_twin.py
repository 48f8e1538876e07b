"""The twin keeps what it is made from, and nearest neighbours across samples do not mind a far point."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.operators import graph
from tesselar.operators import twin as T


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    places = rng.uniform(0, 10, (150, 2))
    label = (places[:, 0] > 5).astype(int)
    wave = np.sin(places[:, 1])
    x = np.column_stack([rng.normal(size=150), 2 + 3 * label + 0.2 * rng.normal(size=150), wave + 0.1 * rng.normal(size=150), np.full(150, 4.0)])
    points = spark.createDataFrame([(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(places, label, strict=True))], "i long, x double, y double, label int")
    v = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(150) for g in range(4)], "i long, gene int, v double").repartition(3)
    return v, points, graph.knn(points, 6)


def test_twin_keeps_moments_and_dependence(sample):
    v, points, edges = sample
    new = T.make_twin(v, points.select("i", "label"), edges, 3).cache()
    cells = lambda d: {(r.label, r.gene): (r.m, r.s) for r in d.join(points.select("i", "label"), "i").groupBy("label", "gene").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    a, b = cells(v), cells(new)
    assert all(b[k] == pytest.approx(a[k], abs=1e-9) for k in a)
    real, made = ({r.gene: r for r in T.gene_features(d, edges).collect()} for d in (v, new))
    assert made[2].autocorrelation > 0.3 and abs(made[0].autocorrelation - real[0].autocorrelation) < 0.2 and made[3].sd == 0
    m = T.match_report(T.gene_features(v, edges), T.gene_features(new, edges)).first()
    assert m.features == 12 and m.match_cosine > 0.9 and m.greatest_mean_gap < 1e-9
    values = lambda d: {(r.i, r.gene): round(r.v, 9) for r in d.collect()}
    assert values(T.make_twin(v.repartition(5), points.select("i", "label"), edges, 3)) == values(new) != values(T.make_twin(v, points.select("i", "label"), edges, 4))
    same = T.match_report(T.gene_features(v, edges), T.gene_features(v, edges)).first()
    assert same.match_l2 == 0 and same.match_cosine == pytest.approx(1)


def test_nearest_across_samples_with_a_far_point(spark):
    rng = random.Random(2)
    left = [(i, rng.random(), rng.random()) for i in range(300)] + [(300, 1e7, 1e7)]
    right = [(i, rng.random(), rng.random()) for i in range(250)] + [(250, -1e7, 3.0), (251, 0.5, 0.5), (252, 0.5, 0.5)]
    frame = lambda rows: spark.createDataFrame(rows, "i long, x double, y double")
    got = {r.i: (r.j, r.d2) for r in graph.knn_between(frame(left), frame(right)).collect()}
    for i, x, y in left:
        d2, j = min(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in right)
        assert got[i][0] == j and got[i][1] == pytest.approx(d2)
    assert graph.knn_between(frame(left[:3]), frame([])).count() == 0
