"""Information of places against its null, and gains foretold from it, on planted data and against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.operators import information as I
from tesselar.operators import nearest
from tesselar.operators.stats import mutual_information

RECORDS = "dataset string, ratio double, gain double"


def planted(spark, spatial, n=120, seed=2):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    places = rng.normal(size=(n, 2)) + (3 * label[:, None] if spatial else 0)
    expression = rng.normal(size=(n, 2)) + 0.8 * label[:, None]
    return spark.createDataFrame([(i, int(label[i]), [float(v) for v in places[i]], [float(v) for v in expression[i]]) for i in range(n)], "i long, label long, places array<double>, expression array<double>")


def test_null_tells_signal_from_chance(spark):
    found = I.permutation_null(planted(spark, True), 19, alpha=0.06).first()
    assert found.p_conditional == pytest.approx(1 / 20)
    assert found.significant and found.z_conditional > 3 and found.conditional > found.mean_conditional and found.threshold_critical > found.threshold_significant
    chance = I.permutation_null(planted(spark, False), 19).first()
    assert not chance.significant and chance.band == "not_above_null" and chance.n_null == 19


def test_groups_are_independent(spark):
    rows = planted(spark, True).select("i", "label", F.concat("places", "expression").alias("vec"))
    one = mutual_information(rows).first().mi
    both = {r.g: r.mi for r in I.information(rows.select(F.lit(1).cast("long").alias("g"), "*").unionByName(rows.filter("i < 40").select(F.lit(2).cast("long").alias("g"), "*"))).collect()}
    assert both[1] == pytest.approx(one) and both[2] == pytest.approx(mutual_information(rows.filter("i < 40")).first().mi)
    alone = spark.createDataFrame([(7, 1, 0, [1.0])], "g long, i long, label long, vec array<double>")
    assert [tuple(r) for r in I.information(alone).collect()] == [(7, 0.0)]


def test_search_by_cells_against_all_pairs(spark, monkeypatch):
    """Many small cells, equal rows, a label of two rows, one of one, and rows that are no numbers; few pairs of rows meet."""
    monkeypatch.setattr(nearest, "CELL", 8)
    monkeypatch.setattr(nearest, "WIDE_CELL", 16)
    rng = np.random.default_rng(4)
    n = 600
    x, g, label = np.round(rng.normal(size=(n, 3)), 2), rng.integers(0, 2, n), rng.integers(0, 3, n)
    x[:20] = x[0]
    label[-3:], g[-3:] = (7, 7, 8), 0
    rows = [(int(g[i]), i, int(label[i]), [float(v) for v in x[i]]) for i in range(n)]
    odd = [(0, n, 0, [float("nan"), 0.0, 0.0]), (0, n + 1, 0, [0.0, float("inf"), 0.0]), (1, n + 2, 1, [None, 0.0, 0.0])]
    search = nearest.Search(spark.createDataFrame(rows + odd, "g long, i long, label long, vec array<double>"), 3, n, 2, 8)
    kth = search.kth()
    got = {r.i: (r.d, r.local_k) for r in kth.collect()}
    m = {r.i: r.m for r in search.within(kth).collect()}
    far = np.abs(x[:, None] - x[None]).max(2)
    far[g[:, None] != g[None]] = np.inf
    want = {}
    for i in range(n):
        d = sorted(v for j, v in enumerate(far[i]) if j != i and label[j] == label[i] and np.isfinite(v))[:3]
        if d:
            want[i] = (d[-1], len(d))
    assert got == want
    assert m == {i: int((far[i] <= d).sum()) - 1 for i, (d, _) in want.items()}
    assert search.rows.select("cell").distinct().count() > 16
    reached = search._reached(search._box(search.rows, ["g", "cell"], F.max(F.lit(0.1)).alias("most")), ["g"], "most", own=True)
    cells = search.rows.select("g", "cell").distinct().groupBy("g").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert reached.count() < cells / 4


def test_shuffles_keep_all_places(spark):
    rows = planted(spark, True, 30)
    d = I.shuffled_places(rows, 2).collect()
    for g in (0, 1, 2):
        assert sorted(tuple(r.places) for r in d if r.g == g) == sorted(tuple(r.places) for r in rows.collect())
    assert {r.i: r.places for r in d if r.g == 0} == {r.i: r.places for r in rows.collect()} != {r.i: r.places for r in d if r.g == 1}


def test_student_tail(spark):
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.228, 10, 0.05), (2.131, 15, 0.05), (2.704, 40, 0.01), (0.0, 5, 1.0)]  # tables of Student's t
    got = spark.createDataFrame([(t, float(df)) for t, df, _ in known], "t double, df double").select("t", "df", I.student_tail(F.col("t"), F.col("df")).alias("p")).collect()
    assert [round(r.p, 3) for r in got] == [p for *_, p in known]


def records(spark, pairs):
    return spark.createDataFrame([(f"d{i}", x, y) for i, (x, y) in enumerate(pairs)], RECORDS)


def test_predictor_statuses(spark):
    rising = [(0.1 * i, 0.2 * i + 0.01 * (i % 2)) for i in range(10)]
    status = lambda pairs: tuple(I.predictor(records(spark, pairs)).first())[3:]
    assert status(rising) == ("supported", "")
    assert status(rising[:5]) == ("underpowered", "sample_size_below_minimum")
    assert status([(x, -y) for x, y in rising]) == ("failed", "correlation_nonpositive")
    assert status([(1.0, y) for _, y in rising]) == ("undefined", "zero_variance_in_ratio_or_gain")
    assert status([(None, 1.0), (0.1, math.nan), (0.2, 0.3)]) == ("undefined", "fewer_than_two_finite_pairs")
    assert status([(0.1, 0.2), (0.3, 0.4)])[0] == "undefined"


def test_calibration_against_a_loop(spark):
    rng = random.Random(3)
    pairs = [(round(rng.random(), 4), round(rng.random(), 4)) for _ in range(9)]
    got = I.gain_calibration(records(spark, pairs)).first()
    x, y = np.array(pairs).T
    slope, intercept = np.polyfit(x, y, 1)
    e = y - intercept - slope * x
    loo = [y[i] - np.polyval(np.polyfit(np.delete(x, i), np.delete(y, i), 1), x[i]) for i in range(9)]
    assert got[:6] == pytest.approx((9, slope, intercept, math.sqrt((e**2).sum() / 7), math.sqrt(np.mean(np.square(loo))), 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()))
    flat = I.gain_calibration(records(spark, [(0.5, 0.1), (0.5, 0.3), (0.5, 0.2)])).first()
    assert flat[:3] == pytest.approx((3, 0.0, 0.2)) and flat.residual_std == pytest.approx(0.1) and flat.r_squared == 0 and flat.reliability == "undefined"
    one_off = I.gain_calibration(records(spark, [(0.5, 0.1), (0.5, 0.3), (0.9, 0.8)])).first()
    want = [0.1 - np.polyval(np.polyfit([0.5, 0.9], [0.3, 0.8], 1), 0.5), 0.3 - np.polyval(np.polyfit([0.5, 0.9], [0.1, 0.8], 1), 0.5), 0.8 - 0.2]
    assert one_off.loo_rmse == pytest.approx(math.sqrt(np.mean(np.square(want))))
    assert I.gain_calibration(records(spark, [(0.5, 0.1)])).first().reliability == "undefined"


def test_expected_gains(spark):
    c = I.gain_calibration(records(spark, [(0.1 * i, 0.3 * i) for i in range(9)]))
    got = {r.dataset: r for r in I.expected_gains(spark.createDataFrame([("a", 0.5), ("b", None)], "dataset string, ratio double"), c).collect()}
    assert got["a"].expected == pytest.approx(1.5) and got["a"].reliability == "moderate" and got["b"].expected is None and got["b"].reliability == "undefined"


def test_spatial_gains(spark):
    rows = [("d", "m@sw0.0", 0.4), ("d", "m@sw0.0", 0.6), ("d", "m@sw0.3", 0.7), ("d", "m@sw0.8", 0.9), ("d", "n@sw0.3", 0.9), ("d", "o@sw0.0", 0.1), ("d", "p@sw0.0", 0.5), ("d", "p@sw0.5", 0.3), ("e", "m@sw0.0", 0.2), ("d", "m@sw0.8", None)]
    assert [tuple(r) for r in I.spatial_gains(spark.createDataFrame(rows, "dataset string, config string, score double")).collect()] == [("d", pytest.approx((0.4 - 0.2) / 2))]
