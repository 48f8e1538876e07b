"""Cases with known answers, and degenerate ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselar.operators import evidence as E
from tesselar.operators import graph, integrate, labels, normalize, qc
from tesselar.plans import methods
from tesselar.sources import assays, bundle, longtable, synthetic
from tesselar.streaming import events


def test_pareto_with_tolerance(spark):
    """Two configurations that trade one axis for another, two that differ by less than the tolerance, and one behind all."""
    rows = [("slow", 0.95, 400.0, 3.0), ("small", 0.55, 35.0, 0.5), ("middle", 0.80, 60.0, 1.1), ("middle again", 0.80, 60.0, 1.1), ("nearly", 0.7999, 60.1, 1.1), ("behind", 0.50, 500.0, 3.5)]
    df = spark.createDataFrame(rows, "config string, accuracy double, speed double, memory double")
    want = {"accuracy": "max", "speed": "min", "memory": "min"}
    assert {r.config for r in E.pareto_frontier(df, want).collect()} == {"slow", "small", "middle", "middle again", "nearly"}
    assert {r.config for r in E.pareto_frontier(df, want, eps_rel=0.0).collect()} == {"slow", "small", "middle", "middle again"}
    layers = {r.config: r.layer for r in E.nondominated_layers(df, want).collect()}
    assert layers["behind"] >= 1 and layers["small"] == 0
    gap = spark.createDataFrame([("a", 1.0, None), ("b", None, 1.0)], "config string, accuracy double, speed double")
    assert E.pareto_frontier(gap, {"accuracy": "max", "speed": "min"}).count() == 2  # no axis in common


def test_ranks(spark):
    df = spark.createDataFrame([("d", "a", 0.9), ("d", "b", 0.2), ("d", "c", 0.5), ("e", "a", None), ("e", "b", 0.1), ("e", "c", 0.1)], "dataset string, config string, score double")
    got = {(r.dataset, r.config): r["rank"] for r in E.average_rank(df, "score", "dataset").collect()}
    assert got == {("d", "a"): 1, ("d", "b"): 3, ("d", "c"): 2, ("e", "a"): 3, ("e", "b"): 1.5, ("e", "c"): 1.5}


def test_adjusted_p_values(spark):
    """Worked by hand: five tests, two of them alike, and one without a value."""
    p = [0.2, 0.004, 0.03, 0.03, 0.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(9, None)], "k int, p double")
    adjusted = lambda how: [r.q for r in E.step_up(df, "p", "q", "k", how).orderBy("k").collect()]
    assert adjusted("bh") == pytest.approx([0.25, 0.02, 0.05, 0.05, 0.5])
    assert adjusted("holm") == pytest.approx([0.4, 0.02, 0.12, 0.12, 0.5])
    assert adjusted("bonferroni") == pytest.approx([1.0, 0.02, 0.15, 0.15, 1.0])


def test_adjusted_p_values_over_ranges(spark):
    """Against plain cumulative extremes, with ties across ranges; frames that look ahead took a square of the tests, 4e8 steps here."""
    m = 20_000
    rng = np.random.default_rng(1)
    p = np.round(rng.random(m) ** 2, 3)
    df = spark.range(m).join(spark.createDataFrame(pd.DataFrame({"id": np.arange(m), "p": p})), "id").withColumnRenamed("id", "k")
    order = np.lexsort((np.arange(m), p))
    r = np.arange(1, m + 1)
    up = lambda scale: np.minimum.accumulate((p[order] * m * scale / r)[::-1])[::-1]
    for how, want in {"bh": up(1.0), "by": up((1.0 / r).sum()), "holm": np.maximum.accumulate(p[order] * (m - r + 1))}.items():
        adjusted = E.step_up(df, "p", "q", "k", how)
        assert adjusted.columns == ["k", "p", "q"]
        assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in adjusted._jdf.queryExecution().executedPlan().toString()
        got = adjusted.toPandas().sort_values("k")["q"].to_numpy()
        assert np.allclose(got[order], np.clip(want, 0, 1), rtol=1e-12, atol=0), how


def test_consensus(spark):
    lab = lambda scores: spark.createDataFrame([(n, "d", "m", 0, float(s)) for n, s in enumerate(scores)], "node int, dataset string, method string, seed int, score double")
    r = E.consensus(lab([0.40, 0.42, 0.44])).first()
    assert (round(r.consensus, 6), r.n_labs, r.status) == (0.42, 3, "verified")
    r = E.consensus(lab([0.42, 0.43, 0.10])).first()
    assert (round(r.consensus, 6), round(r.reproducibility, 4), r.status) == (0.42, 0.6667, "verified")
    assert E.consensus(lab([0.42])).first().status == "unverified"
    assert E.consensus(lab([0.1, 0.9])).first().status == "disputed"


def test_label_agreement(spark):
    t = lambda rows: labels.contingency(spark.createDataFrame(rows, "label int, pred int"))
    assert labels.adjusted_rand(t([(0, 5), (0, 5), (1, 7), (1, 7)])).first().ari == 1
    assert labels.adjusted_rand(t([(0, 0)])).first().ari == 1
    assert labels.normalized_mutual_information(t([(0, 0), (0, 0)])).first().nmi == 1
    assert labels.macro_scores(t([(0, 1), (1, 0)])).first().macro_f1 == 0


def test_neighbours_match_brute_force(spark):
    import random

    random.seed(1)
    pts = [(i, random.random() ** 3, random.random()) for i in range(150)] + [(150, 0.5, 0.5), (151, 0.5, 0.5)]
    got = {}
    for r in graph.knn(spark.createDataFrame(pts, "i long, x double, y double"), 4).collect():
        got.setdefault(r.i, []).append((r.r, r.j))
    for i, x, y in pts:
        want = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in pts if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert graph.knn(spark.createDataFrame([], "i long, x double, y double"), 3).count() == 0
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "i long, x double, y double")
    assert graph.knn(two, 3).count() == 2


def test_qc_degenerate(spark):
    var = spark.createDataFrame([(1, True), (2, False)], "gene_id int, mito boolean")
    expr = spark.createDataFrame([(7, 1, 5.0), (7, 2, 15.0)], "obs_id int, gene_id int, value double")
    r = qc.basic_qc(expr, var, min_genes=1).first()
    assert (r.total, r.n_genes, r.mito_pct) == (20, 2, 25)
    assert qc.basic_qc(expr.limit(0), var).count() == 0
    zero = spark.createDataFrame([(7, 1, 0.0)], "obs_id int, gene_id int, value double")
    assert qc.mitochondrial_qc(zero, var).first().mito_fraction == 0
    assert normalize.library_size_scale(zero).first().value == 0


def test_combat_centres_batches(spark):
    v = [(i, g, float((i * 7 + g * 3) % 11) + (5 if i % 2 else 0)) for i in range(60) for g in range(4)]
    df = spark.createDataFrame(v, "i int, gene int, v double")
    batch = spark.createDataFrame([(i, i % 2) for i in range(60)], "i int, batch int")
    m = {r.batch: r.m for r in integrate.combat(df, batch).join(batch, "i").groupBy("batch").agg(F.avg("v").alias("m")).collect()}
    assert abs(m[0] - m[1]) < 0.5


def test_pipeline_and_plans(spark):
    t = synthetic.make_tissue(spark, 120, 20)
    out, log = methods.run_pipeline(t, [methods.Step("qc", "basic_qc", {"min_genes": 1, "min_counts": 1.0}), methods.Step("normalization", "log1p_cp10k")])
    assert out["expr"].count() > 0 and "counts" in out and [x["method"] for x in log] == ["basic_qc", "log1p_cp10k"]
    assert methods.validate([methods.Step("qc", "nothing"), methods.Step("qc", "basic_qc", {"min_genes": True}), methods.Step("domain_detection", "kmeans")], {"expr", "var", "v"}) != []
    assert [s.method for s in methods.compile_question("Which spatial domains remain after quality control?")] == ["basic_qc", "spatial_graph", "kmeans"]
    with pytest.raises(ValueError):
        methods.compile_question("hello")
    assert methods.list_methods(spark).count() == len({(c, n) for c, n, _ in methods.REGISTRY})
    again = synthetic.make_tissue(spark, 120, 20)["expr"].repartition(7)
    assert again.exceptAll(t["expr"]).count() == 0


def test_bundle_detects_change(spark, tmp_path):
    path = f"{tmp_path}/b"
    bundle.write_bundle({"obs": spark.range(5).toDF("i")}, path)
    assert bundle.read_bundle(spark, path)["obs"].count() == 5
    spark.range(1).toDF("i").write.mode("append").parquet(f"{path}/obs")
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, path)
    with pytest.raises(ValueError):
        bundle.safe_name("../x")


def test_long_csv_is_tolerant(spark, tmp_path):
    (tmp_path / "t.csv").write_text("dataset,method,spatial_weight,seed,ari,seconds,status\nd,a,0.3,1,0.5,2,ok\nd,a,0.3,2,,2,ok\nd,a,0.3,3,x,2,ok\nd,b,,1,0.7,4,Timeout\nd,b,,1,nan,4,ok\n")
    rows = longtable.read_long_csv(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.config, r.seed, r.score, r.secs) for r in rows] == [("a@sw0.3", 1, 0.5, 2.0)]
    mem = spark.createDataFrame([("a", 1000, 1.0, "ok"), ("a", 10000, 2.0, "ok"), ("a", 100000, 58.0, "oom"), ("b", 10000, 3.0, "ok")], "method string, n int, memory_gb double, status string")
    assert {r.method: r.memory_gb for r in longtable.memory_by_scale(mem).collect()} == {"a": 2, "b": 3}


def test_readers(spark, tmp_path):
    spark.createDataFrame([("b1", "g", 2)], "barcode string, feature string, value int").write.parquet(f"{tmp_path}/v/matrix.parquet")
    (tmp_path / "v/spatial").mkdir()
    (tmp_path / "v/spatial/tissue_positions_list.csv").write_text("b1,1,0,0,10,20\n")
    got = assays.read(spark, "Visium", f"{tmp_path}/v")
    assert [(r.x, r.y) for r in got["obs"].collect()] == [(20, 10)]
    with pytest.raises(KeyError):
        assays.read(spark, "other", "x")


def test_evidence_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    line = '{"line_no":%d,"node":%d,"dataset":"d","method":"m","seed":0,"score":0.4,"ingested_at":"2024-01-01T00:00:00Z"}\n'
    schema = "line_no long, node int, dataset string, method string, seed int, score double, ingested_at timestamp"
    (tmp_path / "feed/a.json").write_text(line % (1, 1) + line % (2, 1) + line % (3, 2))
    run = lambda: events.ingest_evidence(spark, f"{tmp_path}/feed", f"{tmp_path}/store", schema).awaitTermination()
    run()
    (tmp_path / "feed/b.json").write_text(line % (1, 1) + line % (4, 3))
    run()
    assert sorted(r.node for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [1, 2, 3]
    assert events.current_consensus(spark, f"{tmp_path}/store").first().status == "verified"


def test_catalogue_and_report(spark):
    from tesselar.plans import report
    from tesselar.sources import catalog

    cat = catalog.catalogue(spark, [("a", "Domains", "visium", "brain", True, 100, "p"), ("b", "svg", "xenium", "liver", False, 10, "q")])
    assert [r.name for r in catalog.list_datasets(cat, task="domains", has_truth=True, max_obs=100).collect()] == ["a"]
    assert catalog.summary(cat).count() == 2
    with pytest.raises(KeyError):
        catalog.get_dataset(spark, cat, "c")
    pts = spark.createDataFrame([(1, 0.0, 0.0, "<x>"), (2, 1.0, 1.0, None)], "i int, x double, y double, label string")
    html = report.report("T<", {"points": report.scatter(pts, "label"), "rows": report.table(pts)}, [])
    assert html.count("<circle") == 2 and "&lt;x&gt;" in html and "T&lt;" in html
    assert "circle" not in report.scatter(pts.limit(0), "label")


def test_rounds_reach_their_end(spark):
    import inspect

    import numpy as np

    from tesselar.operators import domains, svg

    n = 40  # a path with a few chords: five power steps from ones do not reach its ends
    pairs = [(i, i + 1) for i in range(n - 1)] + [(0, 2), (1, 3), (20, 24)]
    adj = np.zeros((n, n))
    for i, j in pairs:
        adj[i, j] = adj[j, i] = 1
    both = spark.createDataFrame(pairs + [(j, i) for i, j in pairs], "i long, j long").withColumns({"d2": F.lit(1.0), "r": F.lit(1)})
    want = np.abs(np.linalg.eigh(adj)[1][:, -1])
    got = {r.i: r.centrality for r in graph.eigenvector_centrality(both).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(list(want), abs=1e-6)
    rows = [(i, g, float((i * 7 + g * 3) % 5 + 1)) for i in range(n) for g in range(3)]
    e = np.array([r[2] for r in rows]).reshape(n, 3)
    e /= e.sum(1, keepdims=True)
    evidence = spark.createDataFrame([(i, g, float(e[i, g])) for i in range(n) for g in range(3)], "i long, label long, p double")
    p = {(r.i, r.label): r.p for r in labels.simplex_deconv(evidence, both, strength=2.0).collect()}
    w, q = adj * np.exp(-1.0), e.copy()
    degree = w.sum(1, keepdims=True)
    step = 1 / (1 + 4.0 * degree.max())
    for _ in range(100):
        q = q - step * (q - e + 2.0 * (degree * q - w @ q))
        for i in range(n):  # the nearest point of the simplex, by bisection on the amount taken off
            lo, hi = q[i].min() - 1, q[i].max()
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.maximum(q[i] - mid, 0).sum() > 1 else (lo, mid)
            q[i] = np.maximum(q[i] - lo, 0)
    assert [p[i, g] for i in range(n) for g in range(3)] == pytest.approx(list(q.ravel()), abs=1e-9)
    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert (default(domains.potts_refined, "rounds"), default(domains.uncertainty, "runs"), default(svg.bootstrap_robust, "n_bootstraps")) == (6, 7, 12)
