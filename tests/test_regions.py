"""Polygons with holes and parts against ray casting over all edges; GeoJSON as tools write it; ranks by ranges; batch scales."""

import json
import random

import numpy as np
import pytest

from tesselar.operators import integrate, regions
from tesselar.operators.relational import rank_correlation, range_ranks
from tesselar.sources.geojson import read_geojson


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def star(rng, cx, cy, r, n=9):
    a = sorted(rng.random() * 2 * np.pi for _ in range(n))
    return [(cx + r * (0.5 + rng.random() / 2) * float(np.cos(t)), cy + r * (0.5 + rng.random() / 2) * float(np.sin(t))) for t in a]


def test_against_all_edges(spark):
    rng = random.Random(5)
    polys = []
    for k in range(25):
        cx, cy, r = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.5, 4.0, 30.0])
        polys.append((k, f"l{k % 4}", [[star(rng, cx, cy, r), star(rng, cx, cy, r / 4)], [star(rng, cx + 3 * r, cy, r / 2)]]))
    pts = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(1500)]
    points = spark.createDataFrame(pts, "i long, x double, y double")
    features = spark.createDataFrame(polys, "poly int, label string, parts array<array<array<struct<x:double,y:double>>>>")
    size = {k: sum(area(p[0]) - sum(map(area, p[1:])) for p in parts) for k, _, parts in polys}
    hits = {i: [(size[k], k, label) for k, label, parts in polys if inside([r for p in parts for r in p], x, y)] for i, x, y in pts}
    assert sum(map(bool, hits.values())) > 100
    assert {r.i: r.label for r in regions.assign(points, features).collect()} == {i: min(h)[2] if h else None for i, h in hits.items()}
    conflict = {i: None if not h else h[0][2] if len({x[2] for x in h}) == 1 else "ambiguous" for i, h in hits.items()}
    assert {r.i: r.label for r in regions.assign(points, features, False).collect()} == conflict and "ambiguous" in conflict.values()
    with pytest.raises(ValueError, match="scale"):
        regions.assign(points.withColumn("x", points["x"] + 1e6), features)


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    f = lambda g, p: {"type": "Feature", "geometry": g, "properties": p}
    features = [
        f({"type": "Polygon", "coordinates": [ring, hole]}, {"classification": {"name": " Tumor "}, "name": "other"}),
        f({"type": "MultiPolygon", "coordinates": [[ring], [[[9, 9], [10, 9], [10, 10]]]]}, {"name": "Stroma"}),
        f({"type": "Point", "coordinates": [1, 2]}, {"name": "p"}), f({"type": "Polygon", "coordinates": [ring]}, {"name": "  "}), f(None, {"name": "x"}), f({"type": "Polygon", "coordinates": [ring]}, None), f({"type": "Polygon", "coordinates": [hole]}, {"own": 7}),
    ]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = sorted(read_geojson(spark, str(tmp_path / "a.json"), "own").collect(), key=lambda r: r.poly.at)
    assert [(r.poly.at, r.label, len(r.parts)) for r in rows] == [(0, "Tumor", 1), (1, "Stroma", 2), (6, "7", 1)]
    points = spark.createDataFrame([(0, 1.5, 1.5), (1, 3.0, 3.0), (2, 9.6, 9.2), (3, 20.0, 0.0)], "i long, x double, y double")
    got = {r.i: r.label for r in regions.assign(points, read_geojson(spark, str(tmp_path))).collect()}
    assert got == {0: "Stroma", 1: "Tumor", 2: "Stroma", 3: None}


def test_range_ranks(spark):
    rng = random.Random(1)
    rows = [(0 if i < 700 else i % 3, rng.choice([None, *range(40)]), i) for i in range(1000)]
    got = {(r.g, r.i): r.at for r in range_ranks(spark.createDataFrame(rows, "g int, v int, i int").repartition(5), ["g"], "v", "i", "at").collect()}
    want = {}
    for g in range(3):
        for k, (_, _, i) in enumerate(sorted((v is not None, v or 0, i) for h, v, i in rows if h == g)):
            want[g, i] = k + 1
    assert got == want


def test_rank_correlation(spark):
    got = {r.g: r.rho for r in rank_correlation(spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0), (0, 3, 5.0), (1, 1, 7.0), (1, 2, 7.0)], "g int, a int, b double"), "g", "a", "b").collect()}
    assert got == {0: pytest.approx(np.corrcoef([1, 2, 3], [1.5, 1.5, 3])[0, 1]), 1: 0}


def test_batch_scales(spark):
    rng = np.random.default_rng(0)
    x = {(i, g): float(rng.integers(0, 6) * (1 + i % 2) + 9 * (i % 2)) for i in range(40) for g in range(2)}
    v = spark.createDataFrame([(i, g, y) for (i, g), y in x.items()], "i int, gene int, v double")
    batch = spark.createDataFrame([(i, i % 2) for i in range(40)], "i int, batch int")
    got = {(r.i, r.gene): r.v for r in integrate.combat_ranks(v, batch).collect()}
    for g in range(2):
        whole = np.array([x[i, g] for i in range(40)])
        for b in (0, 1):
            own = np.array([x[i, g] for i in range(b, 40, 2)])
            ranks = np.array([((own < y).sum() + 1 + (own <= y).sum()) / 2 for y in own])
            want = np.quantile(whole, (ranks - 0.5) / 20)
            assert [got[i, g] for i in range(b, 40, 2)] == pytest.approx(list(want))
    new = {(r.i, r.gene): r.v for r in integrate.combat(v, batch).collect()}
    for g in range(2):
        whole = np.array([x[i, g] for i in range(40)])
        for b in (0, 1):
            own = np.array([x[i, g] for i in range(b, 40, 2)])
            z = (own - own.mean()) / np.sqrt(own.var(ddof=1) + 1e-8)
            delta = (20 * (z.var(ddof=1) + 1e-8) + 4) / 24
            assert [new[i, g] for i in range(b, 40, 2)] == pytest.approx(list(z / np.sqrt(delta) * np.sqrt(whole.var(ddof=1) + 1e-8) + whole.mean()))
