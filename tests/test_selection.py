"""Ranks under resampling, the frozen selector and held-out policies: planted outcomes and plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.operators import selection as S


def scores_of(spark, table):
    return spark.createDataFrame([(u, c, None if v is None else float(v)) for u, row in table.items() for c, v in row.items()], "unit string, config string, score double")


def poisson(draw, unit):
    u = int(hashlib.md5(f"{draw}:{unit}".encode()).hexdigest()[:8], 16) / 2**32
    return next((k for k, p in enumerate(S.POISSON) if u < p), len(S.POISSON))


def test_weights_are_poisson(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("unit")).withColumn("draw", F.lit(3)).select("unit", S.weight("draw", "unit").alias("w")).collect()
    assert all(r.w == poisson(3, r.unit) for r in rows[:500])
    w = np.array([r.w for r in rows])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05


def test_rank_stability_and_posterior(spark):
    rng = random.Random(0)
    table = {f"d{i}": {"A": 0.8 + 0.02 * rng.random(), "B": 0.5 + 0.2 * rng.random(), "C": 0.5 + 0.2 * rng.random(), "D": None} for i in range(12)}
    s = {r.config: r for r in S.rank_stability(scores_of(spark, table), 100).collect()}
    assert s["A"].mean_rank == 1 and s["A"].p_best == pytest.approx(101 / 104) and s["A"].rank_stability == 1 and s["D"].mean_rank == 4 and s["D"].mean_score is None
    post = {}
    for r in S.rank_posterior(scores_of(spark, table), 100).collect():
        post.setdefault(r.config, {})[r.rank] = r.mass
    assert all(sum(p.values()) == pytest.approx(1) and sorted(p) == [1, 2, 3, 4] for p in post.values())
    ranks = {}
    for b in range(1, 101):
        means = {c: np.average([table[u][c] for u in table], weights=[poisson(b, u) for u in table]) for c in "ABC"}
        for i, c in enumerate(sorted("ABC", key=lambda c: -means[c])):
            ranks.setdefault(c, []).append(i + 1)
    assert all(s[c].mean_rank == pytest.approx(np.mean(ranks[c])) and s[c].rank_ci_high == pytest.approx(np.quantile(ranks[c], 0.975)) for c in "ABC")
    assert {r.config: r.mean_rank for r in S.rank_stability(scores_of(spark, table), 20, higher_is_better=False).collect()}["A"] == 3


def test_ties_share_a_rank(spark):
    table = {f"d{i}": {"A": 0.5, "B": 0.5, "C": 0.1} for i in range(4)}
    assert {(r.config, r.rank) for r in S.drawn_ranks(scores_of(spark, table), 10).select("config", "rank").distinct().collect()} == {("A", 1.5), ("B", 1.5), ("C", 3.0)}


def planted(n=60, seed=1):
    """Method b is better where the first feature is high; two more features are noise."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n) * 5 + 2, np.full(n, 3.0)])
    y = np.column_stack([0.5 + 0 * x[:, 0], 0.45 + 0.2 * x[:, 0], 0.2 + 0.01 * rng.normal(size=n)])
    return x, y, ["development" if i < n // 2 else "calibration" if i < 3 * n // 4 else "test" for i in range(n)]


def tables(spark, x, y, folds):
    units = spark.createDataFrame([(f"u{i:03}", f, [float(v) for v in row]) for i, (row, f) in enumerate(zip(x, folds, strict=True))], "unit string, fold string, vec array<double>")
    return units, scores_of(spark, {f"u{i:03}": dict(zip("abc", row, strict=True)) for i, row in enumerate(y)})


def test_selector_is_a_ridge_regression(spark):
    x, y, folds = planted()
    got = S.predicted(*tables(spark, x, y, folds), alpha=2.0).collect()
    dev = np.array([f == "development" for f in folds])
    m, sd = x[dev].mean(0), x[dev].std(0)
    z = (x - m) / np.where(sd > 0, sd, 1)
    beta = np.linalg.solve(z[dev].T @ z[dev] + 2 * np.eye(3), z[dev].T @ (y[dev] - y[dev].mean(0)))
    want = z @ beta + y[dev].mean(0)
    assert len(got) == 180 and all(r.predicted == pytest.approx(want[int(r.unit[1:]), "abc".index(r.config)]) for r in got)


def test_selector_personalises_where_it_pays(spark):
    x, y, folds = planted()
    scored = S.predicted(*tables(spark, x, y, folds))
    chosen = S.choices(scored)
    policy = S.calibrated(chosen, [0.0, 0.05, 10.0])
    rows = {r.threshold: r for r in policy.collect()}
    assert rows[0.05].frozen and rows[0.0].eligible and not rows[10.0].eligible and rows[10.0].coverage == 0
    acts = S.actions(chosen, policy)
    got = {r.unit: (r.selected_config, r.action) for r in acts.collect()}
    assert set(got) == {f"u{i:03}" for i, f in enumerate(folds) if f == "test"} and {a for _, a in got.values()} == {"personalised_set", "global_default"}
    e = S.evaluated(acts, scored, chosen).first()
    assert e.status == "scored" and e.mean_regret_difference < 0 and e.mean_deployed_regret < e.mean_global_regret
    # Scores of the test units have no part in their actions.
    other = np.where(np.array([f == "test" for f in folds])[:, None], 1 - y, y)
    units, shuffled = tables(spark, x, other, folds)
    chosen2 = S.choices(S.predicted(units, shuffled))
    assert {r.unit: (r.selected_config, r.action) for r in S.actions(chosen2, S.calibrated(chosen2, [0.0, 0.05, 10.0])).collect()} == got


def test_selector_without_an_eligible_threshold(spark):
    x, y, folds = planted()
    scored = S.predicted(*tables(spark, x, y, folds))
    chosen = S.choices(scored)
    policy = S.calibrated(chosen, [50.0])
    acts = S.actions(chosen, policy)
    assert {(r.selected_config, r.action, r.predicted_gain) for r in acts.collect()} == {(None, "evidence_required", None)}
    assert tuple(S.evaluated(acts, scored, chosen).first())[:4] == ("evidence_required", 15, 0.0, None)


def test_incomplete_units_take_no_part(spark):
    s = scores_of(spark, {"u": {"a": 1, "b": 2}, "v": {"a": 1, "b": None}, "w": {"a": 3}})
    assert {r.unit for r in S.complete(s).collect()} == {"u"}


def test_policies(spark):
    rng = random.Random(4)
    table = {f"d{i}": {c: round(rng.random(), 3) for c in "abcd" if rng.random() < 0.9} for i in range(8)}
    ranked = [(u, rng.choice("abcde"), rng.random(), rng.random(), 1) for u in list(table)[:-1]] + [("d0", "a", 0.0, 0.0, 2)]
    got = {r.unit: r for r in S.held_out_policies(scores_of(spark, table), spark.createDataFrame(ranked, "q string, config string, score double, confidence double, rank int")).collect()}
    first = {q: (c, s, k) for q, c, s, k, r in ranked if r == 1}
    assert set(got) == set(table)
    gap = lambda o, v: None if v is None else pytest.approx(o - v)
    for u, own in table.items():
        train = {c: round(np.mean([table[x][c] for x in table if x != u and c in table[x]]), 9) for c in "abcd"}
        g = max(train, key=lambda c: (train[c], c))
        oracle = max(own.values())
        c, s, k = first.get(u, (None, None, 0.0))
        beats = s is not None and round(s - train[g] - 0.02, 9) >= 0
        gate = beats and k >= 0.2
        r = got[u]
        assert (r.global_method, r.knn_method, r.knn_beats_global_proxy, r.gated_method, r.gated_action) == (g, c, beats, c if gate else g, "personalised" if gate else "global_default")
        assert r.global_regret == gap(oracle, own.get(g)) and r.knn_regret == gap(oracle, own.get(c)) and r.gated_regret == gap(oracle, own.get(c if gate else g)) and r.random_regret == gap(oracle, np.mean(list(own.values())))
    assert S.held_out_policies(scores_of(spark, dict(list(table.items())[:4])), spark.createDataFrame(ranked, "q string, config string, score double, confidence double, rank int")).count() == 0


def test_noninferiority(spark):
    rows = [(f"u{i}", 0.1 + 0.001 * i, 0.1, 0.1 + (0.2 if i % 2 else 0.0), "personalised" if i % 4 == 0 else "global_default") for i in range(20)]
    p = spark.createDataFrame(rows, "unit string, gated_regret double, global_regret double, knn_regret double, gated_action string")
    got = {r.policy: r for r in S.policy_summary(p).collect()}
    assert got["gated"].noninferior and got["gated"].statistical_noninferior and not got["gated"].superior and got["gated"].personalised_rate == 0.25
    assert not got["knn"].noninferior and got["knn"].personalised_rate == 1 and got["knn"].prob_delta_le_0 == 0 and got["knn"].mean_delta == pytest.approx(0.1)


def test_concordance(spark):
    same = {f"d{i}": {"a": 3, "b": 2, "c": 1} for i in range(4)}
    assert tuple(S.rank_concordance(scores_of(spark, same)).first()) == (4, 3, 1.0)
    assert tuple(S.rank_concordance(scores_of(spark, {"d": {"a": 3, "b": 2}, "e": {"a": 1}})).first()) == (1, 2, None)
