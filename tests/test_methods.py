"""Methods without SQL against plain loops, rules against cases worked from their definitions, and plans on odd inputs."""

import itertools
import json
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.functions import text as N
from tesselar.operators import domains, graph, integrate, recommend, relational, stats, svg
from tesselar.operators import features as X


def grid(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i long, x double, y double")


def matrix(spark, n, genes, seed=5):
    rng = np.random.default_rng(seed)
    m = rng.gamma(1.5, 2.0, size=(n, genes))
    return m, spark.createDataFrame([(i, g, float(m[i, g])) for i in range(n) for g in range(genes)], "i long, gene int, v double")


def nearest(rows, k):
    out = {}
    for i, x, y in rows:
        out[i] = [j for _, j in sorted((math.dist((x, y), (a, b)), j) for j, a, b in rows if j != i)[:k]]
    return out


def test_knn_with_a_far_point_and_repeated_places(spark):
    rows, _ = grid(spark, 150)
    rows += [(500, 1e6, -1e6), (501, 3.0, 3.0), (502, 3.0, 3.0), (503, 3.0, 3.0)]
    points = spark.createDataFrame(rows, "i long, x double, y double")
    got = {}
    for r in graph.knn(points, 4).orderBy("i", "r").collect():
        got.setdefault(r.i, []).append(r.j)
    want = nearest(rows, 4)
    place = {i: (x, y) for i, x, y in rows}
    assert all([math.dist(place[i], place[j]) for j in got[i]] == pytest.approx([math.dist(place[i], place[j]) for j in want[i]]) for i in want)
    assert got[501] == want[501] and len(got) == len(rows)
    _, width, extent = graph._grid(points, 12.0, 1)
    assert width < 10 < extent  # the far point makes no cell of the others wide
    assert graph.knn(points.limit(0), 4).count() == 0 and graph.knn(points.limit(3), 4).count() == 6


def test_adaptive_radius_by_hand(spark):
    """Three points on a line: radii 1, 1 and 3, times one."""
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 4.0, 0.0)], "i long, x double, y double")
    got = {(r.i, r.j): r.weight for r in graph.adaptive_radius(points, 1, 1.0).collect()}
    assert got == {(0, 1): pytest.approx(math.exp(-0.5)), (1, 2): pytest.approx(math.exp(-9 / (2 * 4.0)))}


def test_simplex_of_known_points(spark):
    rows = [([0.2, 0.3, 0.5], [0.2, 0.3, 0.5]), ([2.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 1.0, -5.0], [0.5, 0.5, 0.0]), ([0.0, 0.0, 0.0], [1 / 3] * 3)]
    from tesselar.operators.labels import on_simplex

    df = spark.createDataFrame([(n, x) for n, (x, _) in enumerate(rows)], "n int, x array<double>").select("n", on_simplex(F.col("x")).alias("p"))
    for r in df.collect():
        assert list(r.p) == pytest.approx(rows[r.n][1])


def test_names_and_gate(spark):
    cases = [("Domain", "spatial_domain", "domain"), (None, None, None), (" SVG", "svg", "svg"), ("10x-Visium", "10x-visium", "visium"), ("Visium_HD", "visium_hd", "visium_hd"), ("MERSCOPE", "merscope", "merscope"), ("", None, None)]
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "n int, name string")
    for r in df.select("n", N.normalized_task(F.col("name")).alias("t"), N.platform(F.col("name")).alias("p")).collect():
        assert (r.t, r.p) == cases[r.n][1:]
    both = [("domain", "spatial_domain", "same"), ("domain", "protein_domain", "same_family"), ("svg", "domain", "incompatible"), (None, "svg", "incompatible"), ("own", "own", "same")]
    df = spark.createDataFrame([(n, *c[:2]) for n, c in enumerate(both)], "n int, a string, b string")
    assert [r.x for r in df.orderBy("n").select(N.task_relation(F.col("a"), F.col("b")).alias("x")).collect()] == [c[2] for c in both]

    def refused(value):
        """The definition, on the parsed record."""
        keys, long = [], False

        def walk(v):
            nonlocal long
            if isinstance(v, dict):
                for k, x in v.items():
                    if any(t in k.split(".")[-1].split("[")[0].lower() for t in N.PRIVATE):
                        keys.append(k)
                    walk(x)
            elif isinstance(v, list):
                long |= len(v) > N.LONGEST_NUMBERS and all(isinstance(x, int | float | bool) for x in v)
                for x in v:
                    walk(x)

        walk(value)
        return keys, long

    rng = random.Random(1)
    names = ["score", "Barcode", "a.coords", "coords.a", "layers[0]", 'quo"te', "x:y", "meta", "cell_id[3]", "[counts]"]

    def record(depth):
        if depth == 0:
            return rng.choice([1, 2.5, -3e10, True, None, 'a "counts": [1,2,3,4,5,6,7,8,9] b', "\\", "é", [0.5] * rng.choice([8, 9]), ["1"] * 12, [1] * 8 + [None]])
        return rng.choice([{rng.choice(names): record(depth - 1) for _ in range(rng.randrange(4))}, [record(depth - 1) for _ in range(rng.randrange(3))]])

    records = [{"r": record(rng.randrange(1, 5))} for _ in range(300)]
    df = spark.createDataFrame([(n, json.dumps(r, indent=rng.choice([None, 1]))) for n, r in enumerate(records)], "n int, j string")
    for r in df.select("n", N.private_keys(F.col("j")).alias("k"), N.long_numbers(F.col("j")).alias("l")).collect():
        keys, long = refused(records[r.n])
        assert ([json.loads(f'"{k}"') for k in r.k], r.l) == (keys, long), records[r.n]


def test_signed_ranks_exactly(spark):
    rng = random.Random(2)
    groups = {g: [round(rng.gauss(0.3, 1), 6) for _ in range(n)] for g, n in enumerate((1, 2, 5, 8, 11))}
    rows = [(g, d) for g, ds in groups.items() for d in ds] + [(90, 0.0), (90, 0.0)]
    got = {r.g: r for r in stats.signed_rank(spark.createDataFrame(rows, "g int, d double"), ["g"]).collect()}
    for g, ds in groups.items():
        ranks = {d: n + 1 for n, d in enumerate(sorted(ds, key=abs))}
        w = min(sum(ranks[d] for d in ds if d > 0), sum(ranks[d] for d in ds if d < 0))
        sums = [sum(r for r, s in zip(range(1, len(ds) + 1), signs) if s) for signs in itertools.product((0, 1), repeat=len(ds))]
        p = min(1.0, 2 * sum(s <= w for s in sums) / len(sums))
        assert (got[g].w, got[g].p_value) == (w, pytest.approx(p)) and got[g].n_pairs == len(ds)
    assert got[90].p_value == 1.0
    with pytest.raises(ValueError):
        stats.checked(spark.createDataFrame([(1.5,)], "p double"), "p")


def test_mutual_information(spark):
    rng = np.random.default_rng(4)
    label = [0] * 20 + [1] * 25 + [2] * 2 + [3]
    v = rng.normal(size=(len(label), 2)) + np.array(label)[:, None]
    psi = lambda n: -0.5772156649015329 + sum(1 / k for k in range(1, n))
    far = np.abs(v[:, None] - v[None]).max(2)
    total = 0.0
    for i, c in enumerate(label):
        same = [j for j in range(len(label)) if label[j] == c and j != i]
        if same:
            k = min(3, len(same))
            r = sorted(far[i, same])[k - 1]
            total += psi(len(label)) - psi(len(same) + 1) + psi(k) - psi(max(1, int((far[i] <= r).sum()) - 1))
    rows = spark.createDataFrame([(i, c, v[i].tolist()) for i, c in enumerate(label)], "i long, label long, vec array<double>")
    stats_block, stats.BLOCK = stats.BLOCK, 10
    try:
        assert stats.mutual_information(rows).first().mi == pytest.approx(max(0, total / len(label)))
    finally:
        stats.BLOCK = stats_block


def test_main_effects(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.choice("xy"), rng.choice("123"), 0.0) for _ in range(80)]
    rows = [(a, b, c, "abc".index(a) * 2.0 + (b == "y") + rng.gauss(0, 0.3)) for a, b, c, _ in rows]
    got = {r.factor: r.sum_of_squares for r in stats.main_effects(spark.createDataFrame(rows, "a string, b string, c string, v double"), ["a", "b", "c"], "v").collect()}
    y = np.array([r[3] for r in rows])

    def left(factors):
        cols = [np.ones(len(rows))] + [np.array([r[f] == x for r in rows], float) for f in factors for x in sorted({r[f] for r in rows})[1:]]
        m = np.stack(cols, 1)
        return float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())

    for n, name in enumerate("abc"):
        assert got[name] == pytest.approx(left([f for f in range(3) if f != n]) - left([0, 1, 2]))
    assert got["residual"] == pytest.approx(left([0, 1, 2]))


def z(m):
    sd = m.std(0)
    return np.where(sd > 1e-8, (m - m.mean(0)) / np.where(sd > 1e-8, sd, 1), 0)


def test_virtual_expression(spark):
    rows, points = grid(spark, 30)
    m, v = matrix(spark, 30, 5)
    rng = np.random.default_rng(1)
    patches = rng.normal(size=(30, 2))
    p = spark.createDataFrame([(i, patches[i].tolist()) for i in range(30)], "i long, vec array<double>")
    top = np.argsort(-m.var(0))[:3]

    def fit(x, y):
        xb = np.concatenate([np.ones((30, 1)), x], 1)
        return np.clip(xb @ np.linalg.solve(xb.T @ xb + np.eye(xb.shape[1]), xb.T @ y), 0, None)

    x = z(patches)
    pooled = lambda k: np.array([x[nearest(rows, k)[i]].mean(0) for i in range(30)])
    near = z(pooled(6))
    w = np.exp(np.stack([np.abs(x).mean(1), np.abs(near).mean(1)], 1))
    w /= w.sum(1, keepdims=True)
    want = {
        "morphology": fit(x, m[:, top]), "scellst": np.expm1(np.clip(fit(z(np.concatenate([x, pooled(3)], 1)), np.log1p(m[:, top])), 0, 20)),
        "storm": np.clip(fit(z(np.concatenate([x * w[:, :1], near * w[:, 1:]], 1)), m[:, top] - m[:, top].mean(0)) + m[:, top].mean(0), 0, None),
    }
    for family, values in want.items():
        got = {(r.i, r.gene): r.v for r in X.virtual_expression(p, points, v, family, n_genes=3).collect()}
        assert len(got) == 90 and all(got[i, int(g)] == pytest.approx(values[i, n]) for i in range(30) for n, g in enumerate(top))


def test_features_that_need_a_decomposition(spark):
    rows, points = grid(spark, 40)
    m, v = matrix(spark, 40, 6)
    expr = v.select(F.col("i").alias("obs_id"), F.col("gene").alias("gene_id"), F.col("v").alias("value"))
    out = X.dataset_features(expr, expr.select("gene_id").distinct(), points, v).first()
    s = np.linalg.svd(m - m.mean(0), compute_uv=False)
    p = s**2 / (s**2).sum()
    assert (out.effective_rank_90, out.effective_rank_95) == (np.searchsorted(np.cumsum(p), 0.9) + 1, np.searchsorted(np.cumsum(p), 0.95) + 1)
    assert out.sv_entropy == pytest.approx(-(p * np.log(p)).sum() / np.log(len(p))) and 0.3 < out.cluster_tendency < 0.8
    clumps = spark.createDataFrame([(i, 5.0 * (i % 3) + 0.01 * (i * 7 % 11), 5.0 * (i % 3) + 0.01 * (i * 5 % 13)) for i in range(90)], "i long, x double, y double")
    assert X.hopkins(clumps) > 0.9


def test_svg_on_logged_values_and_draws(spark):
    rows, points = grid(spark, 40)
    m, v = matrix(spark, 40, 3)
    x = z(np.log1p(m))
    near = nearest(rows, 6)
    got = {r.gene: r.score for r in svg.hotspot(v, graph.knn(points, 6)).collect()}
    for g in range(3):
        local = np.array([x[[i, *near[i]], g].mean() for i in range(40)])
        assert got[g] == pytest.approx((local**2).mean())
    import zlib

    runs = []
    for b in range(12):
        some = [r for r in rows if zlib.crc32(f"{b}:{r[0]}".encode()) % 1000 < 750]
        near_b = nearest(some, 6)
        runs.append([np.mean([x[i, g] * x[near_b[i], g].mean() for i, _, _ in some]) for g in range(3)])
    runs = np.array(runs)
    want = np.maximum(runs.mean(0), 0) * (runs > 0).mean(0) / (1 + runs.std(0))
    got = {r.gene: r.score for r in svg.bootstrap_robust(v, lambda p: graph.knn(p, 6), points).collect()}
    assert [got[g] for g in range(3)] == pytest.approx(list(want))


def test_potts_rounds(spark):
    rows, points = grid(spark, 36)
    rng = np.random.default_rng(8)
    emb = rng.normal(size=(36, 2)) + np.array([[2.0 * (r[1] > 5), 0.0] for r in rows])
    start = [int(rng.integers(3)) for _ in rows]
    near = nearest(rows, 5)
    lab = np.array(start)
    for _ in range(6):
        c = np.array([emb[lab == g].mean(0) if (lab == g).any() else np.full(2, np.nan) for g in range(3)])
        d = ((emb[:, None] - c[None]) ** 2).sum(2)
        share = np.array([[np.mean(lab[near[i]] != g) for g in range(3)] for i in range(36)])
        cost = d / np.nanmedian(d) + 0.35 * share
        new = np.nanargmin(cost, axis=1)
        if (new == lab).all():
            break
        lab = new
    e = spark.createDataFrame([(i, emb[i].tolist()) for i in range(36)], "i long, vec array<double>")
    first = spark.createDataFrame(list(enumerate(start)), "i long, domain int")
    got = {r.i: (r.domain, r.coherence) for r in domains.potts_refined(e, first, graph.knn(points, 5)).collect()}
    assert [got[i][0] for i in range(36)] == lab.tolist()
    assert [got[i][1] for i in range(36)] == pytest.approx([np.mean(lab[near[i]] == lab[i]) for i in range(36)])


def test_anchors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    rows, points = grid(spark, 45)
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(45, 3))
    vecs = spark.createDataFrame([(i, vec[i].tolist()) for i in range(45)], "i long, vec array<double>")
    batch = spark.createDataFrame([(i, i % 2) for i in range(45)], "i long, batch int")
    p = points.join(vecs, "i").join(batch, "i")
    got = {(r.i, r.j) for r in integrate.fused_anchors(p.filter("batch = 1"), p.filter("batch = 0")).collect()}
    place = np.array([r[1:] for r in rows])
    a, b = [i for i in range(45) if i % 2], [i for i in range(45) if not i % 2]
    far = lambda m: np.sqrt(((m[a][:, None] - m[b][None]) ** 2).sum(2))
    d = far(vec) / np.median(far(vec)) + far(place) / np.median(far(place))
    want = {(a[i], b[j]) for i, j in enumerate(d.argmin(1)) if d[:, j].argmin() == i}
    assert got == want


def test_joins_with_a_contract(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    with pytest.raises(ValueError, match="repeats"):
        relational.one_to_one(a, b, ["k"]).count()
    with pytest.raises(ValueError, match="only one"):
        relational.one_to_one(a, b.limit(1), ["k"], "inner", complete=True)
    with pytest.raises(ValueError, match="two units"):
        relational.merged_units({"u": a, "w": a.limit(1)}, ["k"])
    with pytest.raises(KeyError):
        relational.Aligned(a, a, a.withColumn("layer", F.lit("l"))).layer("m")
    assert relational.with_suffixes(a, a, ["k"]).columns == ["k", "v_x", "v_y"]


def test_decisions(spark):
    """Evidence on a domain task that is admitted only in part, and what the card makes of it."""
    meta = spark.createDataFrame([
        ("ask", [1.0, 0.0], "Visium", "domain", "spatial_domain", "estimate", False), ("good", [1.0, 0.1], "10x_visium", "domain_detection", "spatial_domain", "Estimated", False),
        ("also", [0.5, 0.5], "xenium", "spatial_domain", "spatial_domain", "non_oracle", False), ("other", [1.0, 0.0], "visium", "protein_domain", "spatial_protein_domain", "estimate", False),
        ("oracle", [1.0, 0.0], "visium", "domain", "spatial_domain", "estimate", True), ("silent", [1.0, 0.0], "visium", "domain", "spatial_domain", None, None), ("circular", [1.0, 0.0], "visium", "domain", "leiden", "estimate", False),
    ], "dataset string, vec array<double>, platform string, task string, truth string, k_policy string, oracle_k boolean")
    asked = meta.filter("dataset = 'ask'")
    audit = recommend.audited(meta, asked)
    assert {r.dataset: list(r.reasons) for r in audit.collect()} == {
        "good": [], "also": [], "other": ["task_mismatch", "ground_truth_incompatible_or_missing"], "oracle": ["oracle_k_forbidden"], "silent": ["k_policy_missing"], "circular": ["ground_truth_incompatible_or_missing"],
    }
    near = recommend.near_references(audit)
    means = spark.createDataFrame([("good", "a@sw0.8", 0.8), ("also", "a@sw0.8", 0.6), ("good", "b", 0.5), ("also", "b", 0.7), ("far", "b", 0.9)], "dataset string, config string, score double")
    ranked = recommend.ranked_methods(near, means, "high")
    rows = {r.config: r for r in ranked.collect()}
    w = {r.dataset: r.similarity for r in near.collect()}
    assert w["good"] == 1.0 and rows["a@sw0.8"].score == pytest.approx((0.8 * w["good"] + 0.6 * w["also"]) / sum(w.values()) + 0.02, abs=1e-4)
    assert (rows["a@sw0.8"].method, rows["a@sw0.8"].wins, rows["b"].wins, rows["b"].support) == ("a", 1, 1, 2)
    base = recommend.baseline(near, ranked, means, recommend.global_bests(means, asked))
    b = base.first()
    assert (b.chosen, b["global"]) == ("a@sw0.8", "a@sw0.8") or b["global"] == "b"
    wanted = asked.withColumns({"metric": F.lit("ARI"), "higher_is_better": F.lit(True)})
    card = lambda **e: recommend.decision_card(wanted, near, ranked, base, evidence=spark.createDataFrame([("ask", e.get("validation"), None, e.get("severe"))], "q string, validation string, spatial string, severe array<string>")).first()
    assert card().action in ("evidence_required", "global_default") and card(severe=["b"]).failure_phenotypes == "warn"
    assert card(validation="fail").action == "global_default"
    nothing = recommend.decision_card(wanted, near.limit(0), ranked.limit(0), base.limit(0)).first()
    assert (nothing.action, nothing.oracle_k_admissibility, nothing.local_support, list(nothing.primary_set)) == ("abstain", "fail", "fail", [])


def test_command_line(spark, tmp_path, capsys):
    from tesselar import __main__ as cli
    from tesselar.sources import bundle, synthetic

    assert cli.main(["doctor"]) == 0 and json.loads(capsys.readouterr().out)["writable"]
    t = synthetic.make_tissue(spark, 60, 10)
    bundle.write_bundle({n: df for n, df in t.items()}, str(tmp_path / "in"))
    assert cli.main(["validate-bundle", str(tmp_path / "in")]) == 0
    (tmp_path / "plan.json").write_text(json.dumps([{"category": "normalization", "method": "log1p_cp10k"}]))
    assert cli.main(["run", str(tmp_path / "plan.json"), str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert cli.main(["report", str(tmp_path / "out"), str(tmp_path / "page.html")]) == 0 and "<table" in (tmp_path / "page.html").read_text()
    (tmp_path / "r.jsonl").write_text('{"score": 1}\n{"barcode": 2}\n')
    assert cli.main(["share", str(tmp_path / "r.jsonl")]) == 1


def plain_ward(x, k):
    """The least growth over all pairs, taken anew after each merge."""
    held = {i: [i] for i in range(len(x))}
    while len(held) > k:
        grow = {(a, b): len(held[a]) * len(held[b]) / (len(held[a]) + len(held[b])) * ((x[held[a]].mean(0) - x[held[b]].mean(0)) ** 2).sum() for a, b in itertools.combinations(sorted(held), 2)}
        a, b = min(grow, key=grow.get)
        held[a] += held.pop(b)
    return {frozenset(v) for v in held.values()}


def peak(run, x):
    tracemalloc.start()
    run(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_tree_against_all_pairs_without_a_matrix():
    rng = np.random.default_rng(8)
    for n, k in ((1, 3), (2, 1), (40, 3), (70, 1), (70, 7)):
        x = rng.normal(size=(n, 3))
        got = domains.ward(k)(x)
        assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == plain_ward(x, k)
    same = domains.ward(2)(np.array([[0.0], [0.0], [0.0], [5.0], [5.0]]))
    assert same.tolist() == [0, 0, 0, 1, 1]
    assert peak(domains.ward(3), rng.normal(size=(1500, 4))) < 1500 * 1500 * 8 / 4


def test_reachability_order_without_a_matrix():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 40])
    got = domains.optics(4)(x)
    assert len(set(got[:30]) & set(got[30:])) == 0
    assert domains.optics()(np.zeros((1, 2))).tolist() == [0]
    assert peak(domains.optics(), rng.normal(size=(3000, 4))) < 3000 * 3000 * 8 / 2


def test_mean_shift_without_a_matrix():
    rng = np.random.default_rng(10)
    for x in (rng.normal(size=(90, 3)), np.round(rng.normal(size=(90, 2))), np.ones((7, 2)), np.zeros((1, 2))):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for q in (0.0, 0.3, 0.77, 1.0):
            assert domains.distance_quantile(x, q) == pytest.approx(np.quantile(d, q), rel=1e-14, abs=0)
    x = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 40])
    assert domains.mean_shift(5.0)(x).tolist() == [0] * 30 + [1] * 30
    assert peak(domains.mean_shift(), rng.normal(size=(3000, 4))) < 3000 * 3000 * 8 / 1.5


def plain_shift(x, h, rounds=30):
    """All distances in every round."""
    y = x.copy()
    for _ in range(rounds):
        w = (((y[:, None] - x[None]) ** 2).sum(2) <= h * h).astype(float)
        new = (w @ x) / np.maximum(w.sum(1, keepdims=True), 1)
        if np.abs(new - y).max() < 1e-6 * h:
            break
        y = new
    modes, out = [], []
    for p in y:
        j = next((j for j, m in enumerate(modes) if ((p - m) ** 2).sum() <= h * h), len(modes))
        modes += [p] if j == len(modes) else []
        out.append(j)
    return out


def test_mean_shift_climbs_in_parts_and_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(size=(200, 3)) + 3, np.ones((20, 3))])
    measured, squares = [], domains._squares
    monkeypatch.setattr(domains, "_squares", lambda axes, rows: measured.append(axes.shape[1] * len(rows)) or squares(axes, rows))
    for h in (0.7, 1.5):
        assert domains.mean_shift(h)(x).tolist() == plain_shift(x, h)
    assert sum(measured) < 2 * 620 * 620
    monkeypatch.undo()
    monkeypatch.setattr(domains, "DEALT", 100)
    emb = spark.createDataFrame([(900 - i, r.tolist()) for i, r in enumerate(x)], "i long, vec array<double>").repartition(3)
    h = float(np.quantile(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 0.3))
    for width, rounds in ((None, 30), (1.5, 30), (0.7, 2)):
        found = {r.i: r.domain for r in domains.mean_shifted(emb, width, rounds).collect()}
        assert [found[i] for i in sorted(found)] == plain_shift(x[::-1], width or h, rounds)


def test_tree_looks_in_parts_and_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) * 9, rng.normal(size=(5, 3)).repeat(4, 0)])
    monkeypatch.setattr(domains, "LEAF", 4)
    for k in (1, 3, 20):
        got = domains.ward(k)(x)
        assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == plain_ward(x, k)
    many, looked = rng.normal(size=(4000, 3)), []
    domains.ward(3, lambda stale, *rest: looked.append(len(stale)) or domains._nearest_clusters(stale, *rest))(many)
    assert len(looked) < 200 and sum(looked) < 5 * len(many)  # a round for many joins, not each by itself
    monkeypatch.setattr(domains, "DEALT", 20)
    monkeypatch.setattr(domains, "DEALT_FROM", 30)
    emb = spark.createDataFrame([(500 - i, r.tolist()) for i, r in enumerate(x)], "i long, vec array<double>").repartition(3)
    found = {r.i: r.domain for r in domains.warded(emb, 3).collect()}
    assert [found[i] for i in sorted(found)] == domains.ward(3)(x[::-1]).tolist()
    assert domains.ward(2)(np.zeros((5, 2))).tolist() == [0, 0, 0, 0, 1] and domains.ward(9)(np.zeros((2, 2))).tolist() == [0, 1]


def plain_order(x, min_samples, cut):
    """All distances of every point."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min_samples - 1]
    reach, open_, order, at = np.full(len(x), np.inf), np.ones(len(x), bool), [], 0
    for _ in range(len(x)):
        order.append(at)
        open_[at] = False
        reach = np.where(open_, np.minimum(reach, np.maximum(core[at], d[at])), reach)
        at = int(np.argmin(np.where(open_, reach, np.inf)))
    seen, out = reach[order], np.zeros(len(x), int)
    out[order] = np.cumsum(seen > 2 * np.quantile(seen[np.isfinite(seen)], cut))
    return out.tolist()


def test_reachability_order_looks_in_parts(monkeypatch):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) * 8, np.ones((40, 3))])
    for rows in (x, np.round(x), x[:2]):  # ties, too, go to the first
        for min_samples, cut in ((1, 0.3), (2, 0.5), (2 if len(rows) < 9 else 40, 0.2)):
            assert domains.optics(min_samples, cut)(rows).tolist() == plain_order(rows, min_samples, cut)
    measured, squares = [], domains._squares
    monkeypatch.setattr(domains, "_squares", lambda axes, rows: measured.append(axes.shape[1] * len(rows)) or squares(axes, rows))
    domains.optics()(rng.normal(size=(4000, 3)))
    assert sum(measured) < 4000 * 4000
