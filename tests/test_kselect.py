"""The number of domains on planted blobs, and indices against plain loops."""

import numpy as np
import pytest

from tesselar.operators import graph
from tesselar.operators import kselect as K


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    places = np.vstack([rng.uniform(lo, lo + 1, (30, 2)) for lo in (0, 3, 6)])
    vecs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, vec array<double>").repartition(3)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)], "i long, x double, y double")
    return x, vecs, graph.knn(points, 5)


def test_all_estimators_find_the_blobs(spark, blobs):
    _, vecs, edges = blobs
    chosen = {r.estimator: r.k for r in K.estimate_k(vecs, edges, 2, 6)[1].collect()}
    assert chosen == dict.fromkeys(("silhouette", "bic_gmm", "gap", "calinski_harabasz", "davies_bouldin", "spatial_silhouette", "ensemble"), 3) | {e: chosen[e] for e in ("bic_gmm", "spatial_coherence")}
    curve, alone = K.estimate_k(vecs, None, 2, 5)
    assert {r.k for r in alone.filter("estimator = 'ensemble'").collect()} == {3} and curve.filter("estimator like 'spatial%'").count() == 0
    truth = spark.createDataFrame([(i, i // 30) for i in range(90)], "i long, label int")
    assert tuple(K.dual_track(vecs, edges, truth, k_max=6).first()) == ("ensemble", 3, 3, True)


def test_indices_against_loops(spark, blobs, monkeypatch):
    x, vecs, edges = blobs
    found, _ = K.curves(vecs, edges, [2, 4])
    points = K.saved(vecs.selectExpr("'expression' as set", "i", "vec"), "test")
    centres = K.clustered(points, [2, 4])
    labels = {r.i: r.labels for r in K.labelled(points, centres, [2, 4]).collect()}
    for j, k in enumerate((2, 4)):
        lab = np.array([labels[i][j] for i in range(90)])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        sil = []
        for i in range(90):
            own = (lab == lab[i]) & (np.arange(90) != i)
            a, b = d[i, own].mean() if own.any() else None, min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
            sil.append(0 if a is None else (b - a) / max(a, b))
        assert found["silhouette"][k] == pytest.approx(np.mean(sil))
        means = np.array([x[lab == c].mean(0) for c in range(k)])
        within = sum(((x[lab == c] - means[c]) ** 2).sum() for c in range(k))
        between = sum((lab == c).sum() * ((means[c] - x.mean(0)) ** 2).sum() for c in range(k))
        assert found["calinski_harabasz"][k] == pytest.approx(between / (k - 1) / (within / (90 - k)))
        s = [np.linalg.norm(x[lab == c] - means[c], axis=1).mean() for c in range(k)]
        assert found["davies_bouldin"][k] == pytest.approx(-np.mean([max((s[a] + s[b]) / np.linalg.norm(means[a] - means[b]) for b in range(k) if b != a) for a in range(k)]))
    # Against a drawn part of the points the mean is near.
    rows = K.labelled(points, centres, [2, 4])
    whole = K.silhouettes(rows, [2, 4])
    monkeypatch.setattr(K, "SILHOUETTE_POINTS", 45)
    assert all(abs(K.silhouettes(rows, [2, 4])[k] - whole[k]) < 0.1 for k in (2, 4))


def test_silhouettes_are_of_all_points(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, ks = 300, [2, 3]
    x, lab = np.concatenate([rng.normal(size=(n - 2, 3)), np.ones((2, 3))]), np.stack([rng.integers(0, k, n) for k in ks], 1)
    lab[:, 1] = np.where(np.arange(n) == 7, 2, lab[:, 1] % 2)  # a cluster of one
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for j, k in enumerate(ks):
        every = np.stack([d[:, lab[:, j] == c].sum(1) for c in range(k)], 1)
        size = np.array([(lab[:, j] == c).sum() for c in range(k)])
        s = []
        for i, own in enumerate(lab[:, j]):
            a, b = every[i, own] / max(size[own] - 1, 1), min(every[i, c] / size[c] for c in range(k) if c != own)
            s.append((b - a) / max(a, b) if size[own] > 1 else 0.0)
        want[k] = np.mean(s)
    rows = spark.createDataFrame([(i, r.tolist(), v.tolist()) for i, (r, v) in enumerate(zip(x, lab, strict=True))], "i long, vec array<double>, labels array<int>").repartition(3)
    monkeypatch.setattr(K, "SILHOUETTE_POINTS", 50)
    assert K.silhouettes(rows, ks) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(K, "_block_count", lambda n: 4)
    monkeypatch.setattr(K, "SUMMED", 32)
    assert K.silhouettes(rows, ks) == pytest.approx(want, abs=1e-12)


def test_rules():
    assert K.by_gap({2: 0.1, 3: 0.5, 4: 0.45, 5: 0.9}, {2: 0, 3: 0, 4: 0.01, 5: 0.01}) == 3
    assert K.by_gap({2: 0.1, 3: 0.2}, {2: 0, 3: 0}) == 3
    assert K.k_range(10) == [2, 3] and K.k_range(10_000) == list(range(2, 13)) and K.k_range(3, 2, 9) == [2]
    flat = {2: 1.0, 3: 1.0}
    assert K.ensemble({m: flat for m in K.WITHOUT_PLACES}) == (2, {2: 0.5, 3: 0.5})
    with_places = {m: {2: 1.0, 3: 0.9, 4: 0.0, 5: 0.1} for m in K.WITH_PLACES} | {"spatial_coherence": {2: 0.1, 3: 0.5, 4: 0.2, 5: 0.4}}
    assert K.ensemble(with_places)[0] == 3


def test_few_and_equal_points(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "i long, vec array<double>")
    assert {r.k for r in K.estimate_k(same, None, 2, 3)[1].filter("estimator = 'silhouette'").collect()} == {2}
    with pytest.raises(ValueError, match="at least 4"):
        K.estimate_k(same.limit(3), None)
