"""Effects with intervals against plain loops, ensembles by their leads, and what is asked of methods that were renamed."""

import hashlib
import random

import numpy as np
import pytest

from tesselar.operators import effects as X
from tesselar.operators.selection import POISSON


def poisson(draw, unit):
    u = int(hashlib.md5(f"{draw}:{unit}".encode()).hexdigest()[:8], 16) / 2**32
    return next((k for k, p in enumerate(POISSON) if u < p), len(POISSON))


def test_causal_effects(spark):
    rng = random.Random(1)
    runs = [("up", lv, r, 0.4 + 0.1 * lv + 0.01 * rng.random()) for lv in (1, 2, 3) for r in range(8)] + [("flat", lv, r, 0.5 + 0.02 * ((r * 5 + lv) % 8)) for lv in (1, 2, 3) for r in range(8)]
    runs += [("few", 1, 0, 0.5), ("few", 3, 0, 0.5), ("few", 3, 1, float("nan")), ("middle", 2, 0, 0.5)]
    got = {r.config: r for r in X.causal_effects(spark.createDataFrame(runs, "config string, level int, replicate int, score double"), 100).collect()}
    lo, hi = ({r: s for c, lv, r, s in runs if c == "up" and lv == end} for end in (1, 3))
    assert got["up"].effect == pytest.approx(np.mean(list(hi.values())) - np.mean(list(lo.values()))) and got["up"].significant and got["up"].support_hi == 8
    draws = [np.average(list(hi.values()), weights=[poisson(b, f"hi:{r}") for r in hi]) - np.average(list(lo.values()), weights=[poisson(b, f"lo:{r}") for r in lo]) for b in range(1, 101)]
    assert (got["up"].ci_low, got["up"].ci_high) == pytest.approx((np.quantile(draws, 0.025), np.quantile(draws, 0.975)))
    assert not got["flat"].significant and got["few"].effect is None and not got["few"].significant and (got["few"].support_lo, got["few"].support_hi) == (1, 1)
    assert got["middle"].effect is None and got["middle"].support_lo == 0
    means = {(r.config, r.level): (r.score, r.n) for r in X.grid_means(spark.createDataFrame(runs, "config string, level int, replicate int, score double")).collect()}
    assert means["few", 3] == (0.5, 1)


def test_donors(spark):
    rows = [("a", "c1", "program", True, 1.0, -1.0, 3), ("a", "c2", "program", True, 2.0, -2.0, 1), ("b", "c3", "program", True, 4.0, 1.0, 5), ("b", "c4", "other", True, 9.0, 9.0, 5), ("b", "c5", "program", False, 9.0, 9.0, 5)]
    d = X.admitted(spark.createDataFrame(rows, "donor string, component string, expected_class string, direction_ok boolean, up double, down double, n long"), "program")
    got = {r.donor: tuple(r)[1:] for r in X.donor_means(d).collect()}
    assert got == {"a": (2, 4, 1.25, -1.25, 1.0), "b": (1, 5, 4.0, 1.0, 0.0)}
    b = {r.effect: r for r in X.donor_bootstrap(d, 60).collect()}
    assert b["up"].mean == pytest.approx(2.625) and b["direction_rate"].mean == 0.5 and b["up"].donors == 2
    draws = []
    for k in range(1, 61):
        w = {c: poisson(k, f"{x}:{c}") for x, c in (("a", "c1"), ("a", "c2"), ("b", "c3"))}
        per = ([(3 * w["c1"] + 2 * w["c2"]) / (3 * w["c1"] + w["c2"])] if w["c1"] + w["c2"] else []) + ([4.0] if w["c3"] else [])
        draws += [np.mean(per)] if per else []
    assert (b["up"].ci_low, b["up"].ci_high, b["up"].median) == pytest.approx((np.quantile(draws, 0.025), np.quantile(draws, 0.975), np.median(draws)))


def test_ensembles(spark):
    ranked = [(q, c, s, r) for q, lead in (("strong", 0.2), ("preferred", 0.05), ("consensus", 0.01)) for c, s, r in (("a", 0.9, 1), ("b", 0.9 - lead, 2), ("c", 0.1, 3))] + [("only", "a", 0.5, 1)]
    got = {r.q: (r.strategy, r.first, r.second) for r in X.ensemble_strategy(spark.createDataFrame(ranked, "q string, config string, score double, rank int")).collect()}
    assert got == {q: (q, "a", None if q == "only" else "b") for q in ("strong", "preferred", "consensus", "only")}
    labels = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y")], "i int, method string, label string")
    assert {r.i: r.label for r in X.consensus_labels(labels).collect()} == {1: "x", 2: "uncertain"}


def test_renamed_parameters():
    from tesselar.plans import methods as M

    new = M.register(M.Method("qc", "renamed_for_a_test", lambda x, least: {"qc": least}, (), (M.Param("least", "int", 1, 0),), "2.0.0"))
    old = M.register(M.Method("qc", "renamed_for_a_test", lambda x: {}, (), (), "1.0.0", deprecated=M.Deprecation("2.0.0", ("qc", "renamed_for_a_test", "2.0.0"), renames=(("minimum", "least"),), removed=("colour",), notes="no colours")))
    try:
        assert M.get_method("qc", "renamed_for_a_test") is new and M.get_method("qc", "renamed_for_a_test", "1.0.0") is old
        step, said = M.migrated(M.Step("qc", "renamed_for_a_test", {"minimum": 3}, "1.0.0"))
        assert (step.version, step.params) == ("2.0.0", {"least": 3}) and "2.0.0" in said and "minimum" in said
        assert M.migrated(step) == (step, "")
        with pytest.raises(ValueError, match="no colours"):
            M.migrated(M.Step("qc", "renamed_for_a_test", {"colour": 1}, "1.0.0"))
        with pytest.raises(ValueError, match="both"):
            M.migrated(M.Step("qc", "renamed_for_a_test", {"minimum": 1, "least": 2}, "1.0.0"))
        for wrong in (dict(renames=(("a", "b"), ("a", "c"))), dict(renames=(("a", "c"), ("b", "c"))), dict(renames=(("a", "b"),), removed=("a",)), dict(since="")):
            with pytest.raises(ValueError):
                M.Deprecation(**{"since": "1", "replacement": ("qc", "x", "1"), **wrong})
        run = M.run_pipeline({}, [M.Step("qc", "renamed_for_a_test", {"minimum": 4}, "1.0.0")])
        assert run[0]["qc"] == 4 and run[1][0]["version"] == "2.0.0" and run[1][0]["migrated"]
    finally:
        for v in ("1.0.0", "2.0.0"):
            del M.REGISTRY["qc", "renamed_for_a_test", v]
