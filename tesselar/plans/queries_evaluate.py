"""Registered queries of the evaluators and the failure atlas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import failures, graph, svg
from . import adapters as A
from .adapters import knn_sql, with_
from .queries_matrix import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _out(metrics: DataFrame) -> DataFrame:
    return rounded(metrics, "value", "normalized")


def _as_rows(source: str, primary: str, metrics: dict[str, str], minimized: dict[str, str] | None = None) -> str:
    """SQL that gives metrics of a one-row ``source`` as rows."""
    low = minimized or {}
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(CAST({x} AS DOUBLE), 6) AS value, round(CAST(least(greatest({low.get(m, x)}, 0), 1) AS DOUBLE), 6) AS normalized, {str(m == primary).upper()} AS primary, '{'minimize' if m in low else 'maximize'}' AS direction FROM {source}" for m, x in metrics.items()
    )


def _ap(name: str, source: str, score: str, positive: str) -> str:
    return f"{name} AS (SELECT sum(tp * ctp / cn) / sum(tp) AS ap FROM (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (SELECT {score} AS s, count(*) FILTER (WHERE {positive}) AS tp, count(*) AS n FROM {source} GROUP BY 1) WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)))"


TRUE_GENES = "gene BETWEEN 3 AND 22"


def _true_genes(s: SparkSession) -> DataFrame:
    return s.range(3, 65).select(F.col("id").cast("int").alias("gene"), F.col("id").between(3, 22).alias("spatial"))


def _fdr(x: str) -> str:
    return f"CASE WHEN 1 - {x} <= 0.05 THEN 1 ELSE 1 - (1 - {x} - 0.05) / 0.95 END"


GENES = (
    "pts", "val", knn_sql(6), "ge AS (SELECT unnest(range(3, 65)) AS gene)", "pr AS (SELECT x.gene, x.i, x.v, y.v AS vj FROM knn JOIN val x ON x.i = knn.i JOIN val y ON y.i = knn.j AND y.gene = x.gene)",
    "sc AS (SELECT gene, round(var_pop(m) / var_pop(v), 9) AS s FROM (SELECT gene, i, avg(vj) AS m, any_value(v) AS v FROM pr GROUP BY 1, 2) GROUP BY 1)", _ap("ap", "sc", "s", TRUE_GENES),
    f"pk AS (SELECT avg(CASE WHEN {TRUE_GENES} THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT * FROM sc ORDER BY s DESC, gene DESC LIMIT 20))", "one AS (SELECT * FROM ap, pk)",
)


@entry("evaluate_variable_genes", with_(*GENES) + _as_rows("one", "gene_pr_auc", {"gene_pr_auc": "ap", "precision_at_k": "p", "null_fdr_calibration": _fdr("p")}))
def evaluate_variable_genes(s, d):
    """The first twenty genes are to be found."""
    return _out(V.variable_genes(svg.variance_ratio(A.values(s, d), graph.knn(A.points(s, d), 6)), _true_genes(s)))


@entry("evaluate_annotation", with_("pts", "ct AS (SELECT label AS t, pred AS p, count(*) AS n FROM pts GROUP BY 1, 2)",
  "cl AS (SELECT t, sum(n) AS sup, coalesce(sum(n) FILTER (WHERE t = p), 0) AS hit FROM ct GROUP BY 1)", "ca AS (SELECT p, sum(n) AS called FROM ct GROUP BY 1)", "f AS (SELECT t, sup, hit / sup AS r, CASE WHEN hit > 0 THEN 2.0 * hit / (sup + coalesce(called, 0)) ELSE 0 END AS f FROM cl LEFT JOIN ca ON t = p)",
  "one AS (SELECT sum(f) / (count(*) + (SELECT count(*) FROM ca WHERE p NOT IN (SELECT t FROM cl))) AS mf, avg(r) AS ba, arg_min(r, (sup, t)) AS rr FROM f)") + _as_rows("one", "macro_f1", {"macro_f1": "mf", "balanced_accuracy": "ba", "rare_type_recall": "rr"}))
def evaluate_annotation(s, d):
    return _out(V.annotation(A.points(s, d).select(F.col("label").alias("truth"), "pred")))


@entry("evaluate_domains", with_("pts", knn_sql(6), "ct AS (SELECT label AS t, pred AS p, count(*) AS n FROM pts GROUP BY 1, 2)", "sz AS (SELECT sum(n) AS al, sum(n * (n - 1) / 2) AS ij FROM ct)", "sa AS (SELECT sum(n * (n - 1) / 2) AS a, -sum(n / al * ln(n / al)) AS h FROM (SELECT sum(n) AS n FROM ct GROUP BY t), sz)", "sb AS (SELECT sum(n * (n - 1) / 2) AS b, -sum(n / al * ln(n / al)) AS g FROM (SELECT sum(n) AS n FROM ct GROUP BY p), sz)",
  "mi AS (SELECT sum(n / al * ln(n * al / (tn * pn))) AS m FROM (SELECT n, sum(n) OVER (PARTITION BY t) AS tn, sum(n) OVER (PARTITION BY p) AS pn FROM ct), sz)", "ar AS (SELECT (ij - a * b / (al * (al - 1) / 2)) / ((a + b) / 2 - a * b / (al * (al - 1) / 2)) AS ari, 2 * m / (h + g) AS nmi FROM sz, sa, sb, mi)",
  "bo AS (SELECT knn.i, bool_or(x.label <> y.label) AS t, bool_or(x.pred <> y.pred) AS p FROM knn JOIN pts x ON x.i = knn.i JOIN pts y ON y.i = knn.j GROUP BY 1)", "one AS (SELECT ari, nmi, (SELECT 2.0 * count(*) FILTER (WHERE t AND p) / (2 * count(*) FILTER (WHERE t AND p) + count(*) FILTER (WHERE t <> p)) FROM bo) AS bf FROM ar)")
  + _as_rows("one", "phenomenon_recovery", {"phenomenon_recovery": "greatest((ari + nmi) / 2, 0)", "boundary_f1": "bf"}) + " UNION ALL SELECT 'adjusted_rand_index', round(ari, 6), round((ari + 1) / 2, 6), FALSE, 'maximize' FROM one")
def evaluate_domains(s, d):
    return _out(V.domains(A.points(s, d).select("i", F.col("label").alias("truth"), "pred"), graph.knn(A.points(s, d), 6)))


@entry("evaluate_neighborhood", with_("pts", knn_sql(6), knn_sql(8, "kn8"), "t AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM knn)", "f AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM kn8)", "one AS (SELECT b / nf AS p, b / nt AS r FROM (SELECT (SELECT count(*) FROM t JOIN f USING (i, j))::DOUBLE AS b, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM f) AS nf))")
  + _as_rows("one", "edge_f1", {"edge_f1": "2 * p * r / (p + r)", "edge_precision": "p", "edge_recall": "r"}))
def evaluate_neighborhood(s, d):
    p = A.points(s, d)
    return _out(V.neighborhood(graph.knn(p, 6), graph.knn(p, 8)))


SHARES = """sh AS (SELECT vec_id AS i, k AS label, abs(CAST(embedding[k] AS DOUBLE)) / (abs(CAST(embedding[3] AS DOUBLE)) + abs(CAST(embedding[4] AS DOUBLE)) + abs(CAST(embedding[5] AS DOUBLE))) AS p, abs(CAST(embedding[k + 3] AS DOUBLE)) / (abs(CAST(embedding[6] AS DOUBLE)) + abs(CAST(embedding[7] AS DOUBLE)) + abs(CAST(embedding[8] AS DOUBLE))) AS q FROM embeddings, (SELECT unnest([3, 4, 5]) AS k))"""


def _spearman(name: str, source: str, by: str, a: str, b: str) -> str:
    """SQL of ``name(by, rho)``: ties averaged, 0 where one side is constant."""
    rank = lambda x: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
    return f"{name} AS (SELECT {by}, CASE WHEN var_pop(ra) * var_pop(rb) > 0 THEN covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) ELSE 0 END AS rho FROM (SELECT {by}, {rank(a)} AS ra, {rank(b)} AS rb FROM {source}) GROUP BY 1)"


@entry("evaluate_deconvolution", with_(SHARES, "rs AS (SELECT label, round(p, 9) AS a, round(q, 9) AS b FROM sh)", _spearman("rh", "rs", "label", "a", "b"),
  "js AS (SELECT i, sum(0.5 * p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + 0.5 * q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) AS j FROM sh GROUP BY 1)", "one AS (SELECT (SELECT sqrt(avg((p - q) * (p - q))) FROM sh) AS e, (SELECT 1 - avg(j) / ln(2) FROM js) AS js, (SELECT (avg(rho) + 1) / 2 FROM rh) AS c)")
  + _as_rows("one", "proportion_rmse", {"proportion_rmse": "e", "jensen_shannon_similarity": "js", "cell_type_correlation": "c"}, {"proportion_rmse": "1 - least(e, 1)"}))
def evaluate_deconvolution(s, d):
    """Shares of three components against those of the next three."""
    e = A.table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.explode(F.array(*[F.lit(k) for k in (3, 4, 5)])).alias("label"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    at = lambda k: F.element_at("v", k)
    return _out(V.deconvolution(e.select("i", "label", (at(F.col("label")) / (at(3) + at(4) + at(5))).alias("p"), (at(F.col("label") + 3) / (at(6) + at(7) + at(8))).alias("q"))))


PIXELS = "px AS (SELECT user_id % 20 AS t, CASE WHEN event_id % 10 = 0 THEN (user_id + 1) % 20 ELSE user_id % 20 END AS p FROM events)"


@entry("evaluate_segmentation", with_(PIXELS, "ov AS (SELECT t, p, n / (nt + np - n)::DOUBLE AS iou FROM (SELECT t, p, count(*) AS n FROM px WHERE t <> 0 AND p <> 0 GROUP BY 1, 2) JOIN (SELECT t, count(*) AS nt FROM px GROUP BY 1) USING (t) JOIN (SELECT p, count(*) AS np FROM px GROUP BY 1) USING (p))",
  "ma AS (SELECT max(iou) AS iou FROM ov GROUP BY t)", "nn AS (SELECT count(DISTINCT t) FILTER (WHERE t <> 0) AS nt, count(DISTINCT p) FILTER (WHERE p <> 0) AS np FROM px)", "one AS (SELECT (SELECT count(*) FROM ma WHERE iou >= 0.5) AS tp, (SELECT sum(iou) FROM ma) AS su, nt, np FROM nn)")
  + _as_rows("one", "instance_ap50", {"instance_ap50": "tp / (nt + np - tp)::DOUBLE", "mean_matched_iou": "su / least(nt, np)", "count_error": "abs(np - nt) / greatest(nt, 1)::DOUBLE"}, {"count_error": "1 - least(abs(np - nt) / greatest(nt, 1)::DOUBLE, 1)"}))
def evaluate_segmentation(s, d):
    """Events are pixels; a tenth of every instance is taken for the next one's. Each instance overlaps itself most."""
    u = F.col("user_id")
    return _out(V.segmentation(A.table(s, d, "events").select((u % 20).alias("truth"), F.when(F.col("event_id") % 10 == 0, (u + 1) % 20).otherwise(u % 20).alias("pred"))))


def _signal(name: str, source: str, keep: str) -> str:
    """SQL of ``name(ap)``: average precision of the genes' rank correlations with their neighbours, among kept observations."""
    return ",\n".join((
        f"{name}p AS (SELECT x.gene, x.i, round(any_value(x.v), 12) AS v, round(avg(y.v), 12) AS m FROM knn JOIN {source} x ON x.i = knn.i JOIN {source} y ON y.i = knn.j AND y.gene = x.gene WHERE knn.i IN ({keep}) AND knn.j IN ({keep}) GROUP BY 1, 2)",
        _spearman(f"{name}r", f"{name}p", "gene", "v", "m"), f"{name}s AS (SELECT gene, round(abs(rho), 9) AS s FROM {name}r)", _ap(name, f"{name}s", "s", TRUE_GENES),
    ))


@entry("evaluate_qc", with_("pts", "val", knn_sql(6), "vv AS (SELECT i, gene, v FROM val)", "va AS (SELECT i, gene, v + CASE WHEN gene > 40 THEN v ELSE 0 END AS v FROM val WHERE i IN (SELECT i FROM pts WHERE pred <> 3))", _signal("sa", "vv", "SELECT i FROM pts WHERE pred <> 3"), _signal("sb", "va", "SELECT i FROM pts WHERE pred <> 3"),
  "fl AS (SELECT label = 0 AS bad, CASE WHEN pred = 3 THEN 1.0 ELSE 0.0 END AS f FROM pts)", _ap("qa", "fl", "f", "bad"), "one AS (SELECT qa.ap AS a, (SELECT avg(1 - f) FROM fl WHERE NOT bad) AS n, least(greatest(sb.ap / greatest(sa.ap, 1e-12), 0), 1) AS s FROM qa, sa, sb)")
  + _as_rows("one", "qc_auprc", {"qc_auprc": "a", "normal_retention": "n", "phenomenon_signal_retention": "s"}))
def evaluate_qc(s, d):
    """Observations of one prediction are dropped, those of one label are bad."""
    p, v = A.points(s, d), A.values(s, d)
    kept = p.filter("pred <> 3").select("i")
    after = v.join(kept, "i", "left_semi").withColumn("v", F.col("v") + F.when(F.col("gene") > 40, F.col("v")).otherwise(0.0))
    signal = V.signal_retention(rounded(v, "v", dp=12), rounded(after, "v", dp=12), graph.knn(p, 6), _true_genes(s))
    return _out(V.qc(p.select("i", (F.col("label") == 0).alias("bad")), kept, signal))


@entry("evaluate_normalization", with_("pts", "val", "cnt", knn_sql(6), "af AS (SELECT i, gene, ln(1 + 10 * v / t) AS v FROM cnt JOIN (SELECT i, sum(v) AS t FROM cnt GROUP BY 1) USING (i))", _signal("sa", "cnt", "SELECT i FROM pts"), _signal("sb", "af", "SELECT i FROM pts"),
  "gm AS (SELECT 0 AS g, round(avg(c.v), 9) AS a, round(avg(af.v), 9) AS b FROM cnt c JOIN af USING (i, gene) GROUP BY gene)", _spearman("rh", "gm", "g", "a", "b"), "cr AS (SELECT stddev_pop(t) / abs(avg(t)) AS c FROM (SELECT sum(v) AS t FROM cnt GROUP BY i))", "co AS (SELECT stddev_pop(t) / abs(avg(t)) AS c FROM (SELECT sum(v) AS t FROM af GROUP BY i))",
  "one AS (SELECT least(greatest(sb.ap / greatest(sa.ap, 1e-12), 0), 1) AS s, (rho + 1) / 2 AS r, 1 - least(co.c / cr.c, 1) AS n FROM sa, sb, rh, cr, co)") + _as_rows("one", "phenomenon_signal_retention", {"phenomenon_signal_retention": "s", "marker_rank_preservation": "r", "library_nuisance_removal": "n"}))
def evaluate_normalization(s, d):
    before = A.counts(s, d)
    after = before.join(before.groupBy("i").agg(F.sum("v").alias("t")), "i").select("i", "gene", F.log1p(10 * F.col("v") / F.col("t")).alias("v"))
    signal = V.signal_retention(rounded(before, "v", dp=12), rounded(after, "v", dp=12), graph.knn(A.points(s, d), 6), _true_genes(s))
    return _out(V.normalization(before, after, signal))


@entry("evaluate_integration", with_("em AS MATERIALIZED (SELECT vec_id AS i, CAST(label AS INTEGER) AS label, vec_id % 3 AS b, CAST(embedding[3:64] AS DOUBLE[]) AS v FROM embeddings)",
  "ne AS MATERIALIZED (SELECT x.i, x.label AS l, y.label AS l2, x.b, y.b AS b2 FROM em x JOIN em y ON x.i <> y.i QUALIFY row_number() OVER (PARTITION BY x.i ORDER BY list_distance(x.v, y.v), y.i) <= 8)", "vo AS (SELECT i, l, arg_min(l2, (-n, l2)) AS p FROM (SELECT i, l, l2, count(*) AS n FROM ne GROUP BY 1, 2, 3) GROUP BY 1, 2)",
  "ct AS (SELECT l AS t, p, count(*)::DOUBLE AS n FROM vo GROUP BY 1, 2)", "ss AS (SELECT sum(n) AS al FROM ct)", "mi AS (SELECT 2 * sum(n / al * ln(n * al / (tn * pn))) / ((SELECT -sum(n / al * ln(n / al)) FROM (SELECT sum(n) AS n FROM ct GROUP BY t), ss) + (SELECT -sum(n / al * ln(n / al)) FROM (SELECT sum(n) AS n FROM ct GROUP BY p), ss)) AS nmi FROM (SELECT n, sum(n) OVER (PARTITION BY t) AS tn, sum(n) OVER (PARTITION BY p) AS pn FROM ct), ss)",
  "va AS (SELECT greatest(1 - least(sum(s) / count(*), 1), 0) AS o FROM (SELECT g, var_pop(x) AS s FROM (SELECT unnest(range(62)) AS g, unnest(v) AS x FROM em) GROUP BY 1))",
  "one AS (SELECT avg(CASE WHEN l = l2 THEN 1.0 ELSE 0.0 END) AS a, least(avg(CASE WHEN b <> b2 THEN 1.0 ELSE 0.0 END) / (SELECT 1 - sum(power(n / (SELECT count(*) FROM em)::DOUBLE, 2)) FROM (SELECT count(*) AS n FROM em GROUP BY b)), 1) AS m, (SELECT nmi FROM mi) AS nmi, (SELECT o FROM va) AS o FROM ne)")
  + _as_rows("one", "biological_neighborhood_conservation", {"biological_neighborhood_conservation": "a", "batch_mixing": "m", "phenomenon_recoverability": "nmi", "oversmoothing_penalty": "o"}, {"oversmoothing_penalty": "1 - o"}))
def evaluate_integration(s, d):
    e = A.table(s, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("i"), F.slice("embedding", 3, 62).cast("array<double>").alias("vec"))
    return _out(V.integration(vectors, e.select(F.col("vec_id").alias("i"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 3).alias("batch"))))


@entry("evaluate_communication", with_("pr AS (SELECT s_nationkey AS so, c_nationkey AS ta, p_brand AS li, p_type AS re, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)",
  "ac AS (SELECT so, ta, li, re FROM pr WHERE so = ta)", "top AS (SELECT so, ta, li, re FROM pr ORDER BY q DESC, so, ta, li, re LIMIT (SELECT greatest(count(*), 1) FROM ac))", "one AS (SELECT (SELECT count(*) FROM top JOIN ac USING (so, ta, li, re)) / greatest((SELECT count(*) FROM ac), 1)::DOUBLE AS p)")
  + _as_rows("one", "lr_pr_auc", {"lr_pr_auc": "p", "lr_precision_at_k": "p", "null_fdr_calibration": _fdr("p")}))
def evaluate_communication(s, d):
    """Suppliers' nations send to customers', brands and types are the pairs; within a nation they are active."""
    t = lambda n: A.table(s, d, n)
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    f = j.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target"), F.col("p_brand").alias("ligand"), F.col("p_type").alias("receptor")).agg((-F.sum("l_quantity")).alias("rank"))
    return _out(V.communication(f, f.withColumn("active", F.col("source") == F.col("target"))))


# --- the failure atlas: three rules that deal labels, on observations of three conditions and five runs

RUNS = """ru AS MATERIALIZED (SELECT 'rule_' || m AS method, CASE vec_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard_noise' ELSE 'hard_domains' END AS condition, (vec_id // 3) % 5 AS run, CAST(label AS INTEGER) AS t,
  CASE WHEN m = 1 AND vec_id % 3 = 0 THEN CAST(label AS INTEGER) WHEN m = 1 AND embedding[3] > 0 THEN CAST(label AS INTEGER) ELSE CAST(floor(m * CAST(embedding[2 + m] AS DOUBLE) * 8) AS INTEGER) END AS p FROM embeddings, (SELECT unnest([1, 2, 3]) AS m))"""
PROFILES = """ct AS (SELECT method, condition, run, t, p, count(*)::DOUBLE AS n FROM ru GROUP BY 1, 2, 3, 4, 5), al AS (SELECT method, condition, run, sum(n) AS al, sum(n * (n - 1) / 2) AS ij FROM ct GROUP BY 1, 2, 3),
ts AS (SELECT method, condition, run, t, sum(n) AS n FROM ct GROUP BY 1, 2, 3, 4), ps AS (SELECT method, condition, run, p, sum(n) AS n FROM ct GROUP BY 1, 2, 3, 4),
ta AS (SELECT method, condition, run, count(*) AS nt, sum(n * (n - 1) / 2) AS a FROM ts GROUP BY 1, 2, 3), pa AS (SELECT method, condition, run, count(*) AS np, sum(n * (n - 1) / 2) AS b, count(*) FILTER (WHERE n < 0.05 * al) AS mi, coalesce(sum(n) FILTER (WHERE n < 0.05 * al), 0) AS cr FROM ps JOIN al USING (method, condition, run) GROUP BY 1, 2, 3),
fr AS (SELECT method, condition, run, max(CASE WHEN k > 0 THEN k ELSE q END) AS mf FROM (SELECT ct.method, ct.condition, ct.run, t, count(*) FILTER (WHERE ct.n / ts.n >= 0.05) AS k, count(*) AS q FROM ct JOIN ts USING (method, condition, run, t) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
me AS (SELECT method, condition, run, max(CASE WHEN k > 0 THEN k ELSE q END) AS mm FROM (SELECT ct.method, ct.condition, ct.run, p, count(*) FILTER (WHERE ct.n / ps.n >= 0.05) AS k, count(*) AS q FROM ct JOIN ps USING (method, condition, run, p) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
pf AS MATERIALIZED (SELECT *, least(greatest((mf - 1) / 4.0, 0), 1) AS frag, least(greatest((mm - 1) / 2.0, 0), 1) AS mer, greatest(least(0.5 * mi / np + 0.5 * cr / al / 0.05, 1), CASE WHEN mi >= 2 THEN mi / np ELSE 0 END) AS noi,
  CASE WHEN al < 2 OR (a + b) / 2 = a * b / (al * (al - 1) / 2) THEN 1 ELSE (ij - a * b / (al * (al - 1) / 2)) / ((a + b) / 2 - a * b / (al * (al - 1) / 2)) END AS ari FROM al JOIN ta USING (method, condition, run) JOIN pa USING (method, condition, run) JOIN fr USING (method, condition, run) JOIN me USING (method, condition, run))"""
ATLAS = """fa AS (SELECT method, avg(frag) FILTER (WHERE condition <> 'easy') AS f, avg(mer) FILTER (WHERE condition <> 'easy') AS m, avg(noi) FILTER (WHERE condition <> 'easy') AS n, count(*) FILTER (WHERE condition <> 'easy') AS ne, count(*) FILTER (WHERE condition <> 'easy' AND (ari < 0.7 OR mf >= 5 OR mm >= 3 OR mi > 0)) AS nf,
  avg(ari) FILTER (WHERE condition = 'easy') AS e, avg(ari) FILTER (WHERE condition <> 'easy') AS h FROM pf GROUP BY 1),
st AS (SELECT *, CASE WHEN e IS NULL OR h IS NULL OR e < 0.7 OR e <= h THEN 0 WHEN h <= 0.2 THEN 1 ELSE least(greatest((e - h) / greatest(e - 0.2, 1e-8), 0), 1) END AS s FROM fa)"""


def _runs(s: SparkSession, d: str) -> DataFrame:
    e, m = A.table(s, d, "embeddings").withColumn("m", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))), F.col("m")
    label, third = F.col("label").cast("int"), F.col("vec_id") % 3
    dealt = F.floor(m * F.element_at("embedding", m + 2).cast("double") * 8).cast("int")
    pred = F.when((m == 1) & (third == 0), label).when((m == 1) & (F.element_at("embedding", 3) > 0), label).otherwise(dealt)
    return e.select(F.concat(F.lit("rule_"), "m").alias("method"), F.when(third == 0, "easy").when(third == 1, "hard_noise").otherwise("hard_domains").alias("condition"), (F.floor(F.col("vec_id") / 3) % 5).alias("run"), label.alias("truth"), pred.alias("pred"))


@entry("failure_profiles", with_(RUNS, PROFILES) + "SELECT method, condition, run, round(frag, 6) AS fragmentation, round(mer, 6) AS merge, round(noi, 6) AS noise, round(ari, 6) AS ari, mf >= 5 AS fragmented, mm >= 3 AS merged, mi > 0 AS noisy, nt AS n_true, np AS n_pred, mf AS most_fragments, mm AS most_merged, mi AS n_micro, round(cr / al, 6) AS micro_share FROM pf")
def failure_profiles(s, d):
    return rounded(failures.profiles(_runs(s, d)), "fragmentation", "merge", "noise", "ari", "micro_share")


@entry("failure_atlas", with_(RUNS, PROFILES, ATLAS) + """SELECT method, round(f, 6) AS fragmentation, round(m, 6) AS merge, round(n, 6) AS noise, round(s, 6) AS structural, CASE WHEN greatest(f, m, n, s) < 1e-9 THEN 'none' WHEN round(f, 9) = round(greatest(f, m, n, s), 9) THEN 'fragmentation' WHEN round(m, 9) = round(greatest(f, m, n, s), 9) THEN 'merge' WHEN round(n, 9) = round(greatest(f, m, n, s), 9) THEN 'noise' ELSE 'structural' END AS dominant_mode,
  ne AS n_evaluations, nf AS n_failures, round(e, 6) AS ari_easy, round(h, 6) AS ari_hard FROM st""")
def failure_atlas(s, d):
    return rounded(failures.atlas(failures.profiles(_runs(s, d))), "fragmentation", "merge", "noise", "structural", "ari_easy", "ari_hard")


@entry("failure_contributions", with_(RUNS, PROFILES) + "SELECT method, condition, round(avg(frag), 6) AS fragmentation, round(avg(mer), 6) AS merge, round(avg(noi), 6) AS noise FROM pf WHERE condition <> 'easy' GROUP BY 1, 2")
def failure_contributions(s, d):
    return rounded(failures.contributions(failures.profiles(_runs(s, d))), "fragmentation", "merge", "noise")
