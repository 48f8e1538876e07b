"""Registered queries over annotated matrices, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import crc32_sql, erfc_sql
from ..operators import graph, integrate, labels, normalize, qc, svg
from . import adapters as A
from .adapters import knn_sql, with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, dp: int = 6) -> DataFrame:
    """Doubles to ``dp`` places, as the SQL has them; minus zero is zero."""
    return df.withColumns({c: F.round(c, dp) + F.lit(0.0) for c in cols})


def n_vars(s: SparkSession, d: str) -> DataFrame:
    return A.var(s, d).agg(F.count("*"))


STATS = "st AS (SELECT obs_id, sum(value) AS total, count(*) FILTER (WHERE value > 0) AS n_genes, CASE WHEN sum(value) > 0 THEN sum(CASE WHEN mito THEN value ELSE 0 END) * 100 / sum(value) ELSE 0 END AS mito_pct FROM expr LEFT JOIN var USING (gene_id) GROUP BY 1)"


@entry("basic_qc", with_("expr", "var", STATS, "m1 AS (SELECT median(ln(1 + total)) AS mc, median(ln(1 + n_genes)) AS mg FROM st)", "m2 AS (SELECT median(abs(ln(1 + total) - mc)) AS dc, median(abs(ln(1 + n_genes) - mg)) AS dg FROM st, m1)") + """
SELECT obs_id, total, n_genes, round(mito_pct, 6) AS mito_pct FROM st, m1, m2
WHERE (dc = 0 OR abs(ln(1 + total) - mc) <= 5.0 * dc * 1.4826) AND (dg = 0 OR abs(ln(1 + n_genes) - mg) <= 5.0 * dg * 1.4826) AND total >= 10 AND n_genes >= 3 AND mito_pct <= 40""")
def basic_qc(s, d):
    return rounded(qc.basic_qc(A.expr(s, d), A.var(s, d)), "mito_pct")


@entry("qc_then_normalize_top_genes", with_("expr", "var", STATS, "m1 AS (SELECT median(ln(1 + total)) AS mc, median(ln(1 + n_genes)) AS mg FROM st)", "m2 AS (SELECT median(abs(ln(1 + total) - mc)) AS dc, median(abs(ln(1 + n_genes) - mg)) AS dg FROM st, m1)",
"ok AS (SELECT obs_id FROM st, m1, m2 WHERE (dc = 0 OR abs(ln(1 + total) - mc) <= 5.0 * dc * 1.4826) AND (dg = 0 OR abs(ln(1 + n_genes) - mg) <= 5.0 * dg * 1.4826) AND total >= 10 AND n_genes >= 3 AND mito_pct <= 40)",
"nrm AS (SELECT obs_id, gene_id, ln(1 + value * 10000 / sum(value) OVER (PARTITION BY obs_id)) AS v FROM expr WHERE obs_id IN (SELECT obs_id FROM ok))") + """
SELECT gene_id, round(sum(v) / n, 6) AS mean, round(sum(v * v) / n - (sum(v) / n) * (sum(v) / n), 6) AS variance
FROM nrm, (SELECT count(*) AS n FROM ok) GROUP BY gene_id, n ORDER BY round(sum(v * v) / n - (sum(v) / n) * (sum(v) / n), 9) DESC, gene_id LIMIT 20""")
def qc_then_normalize_top_genes(s, d):
    """The flagship: filter observations, normalise the rest, rank genes by variance with zeros counted."""
    e = A.expr(s, d)
    ok = qc.basic_qc(e, A.var(s, d)).select("obs_id")
    nrm = normalize.log1p_cp10k(e.join(ok, "obs_id", "left_semi"))
    n = ok.agg(F.count("*").alias("n"))
    g = nrm.groupBy("gene_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")).crossJoin(F.broadcast(n))
    mean = F.col("s1") / F.col("n")
    g = g.select("gene_id", mean.alias("mean"), (F.col("s2") / F.col("n") - mean * mean).alias("variance"))
    return rounded(g.orderBy(F.desc(F.round("variance", 9)), "gene_id").limit(20), "mean", "variance")


@entry("gene_complexity_qc", with_("expr") + "SELECT obs_id, count(*) FILTER (WHERE value > 0) AS n_genes, count(*) FILTER (WHERE value > 0) < 4 AS low_complexity FROM expr GROUP BY 1")
def gene_complexity_qc(s, d):
    return qc.gene_complexity_qc(A.expr(s, d), 4)


@entry("library_size_qc", with_("expr") + "SELECT obs_id, sum(value) AS total, sum(value) < 100 AS low_counts FROM expr GROUP BY 1")
def library_size_qc(s, d):
    return qc.library_size_qc(A.expr(s, d), 100.0)


@entry("mitochondrial_qc", with_("expr", "var", STATS) + "SELECT obs_id, round(mito_pct / 100, 6) AS mito_fraction, mito_pct / 100 > 0.2 AS high_mito FROM st")
def mitochondrial_qc(s, d):
    return rounded(qc.mitochondrial_qc(A.expr(s, d), A.var(s, d)), "mito_fraction")


@entry("adaptive_saturation_qc", with_("expr", "var", STATS, "sc AS (SELECT median(total) / ln(2) AS scale FROM st WHERE total > 0)", "nv AS (SELECT count(*) AS nv FROM var)",
"s AS (SELECT obs_id, least(greatest(n_genes / (nv * (1 - exp(-total / scale))), 0), 2) AS score FROM st, sc, nv)", "q AS (SELECT quantile_cont(score, 0.05) AS q FROM s)") + "SELECT obs_id, round(score, 9) AS score, score < q AS flag FROM s, q")
def adaptive_saturation_qc(s, d):
    return rounded(qc.adaptive_saturation_qc(A.expr(s, d), n_vars(s, d)), "score", dp=9)


POS = "pos AS (SELECT i, gene, abs(v) AS v FROM val)"


def positive(s, d):
    return A.values(s, d).select("i", "gene", F.abs("v").alias("v"))


@entry("spatial_entropy_qc", with_("pts", "val", POS, knn_sql(6), "nm AS (SELECT k.i, p.gene, sum(p.v) / 6 AS m FROM knn k JOIN pos p ON k.j = p.i GROUP BY 1, 2)",
"l AS (SELECT i, 0.5 * (coalesce(v, 0) + coalesce(m, 0)) AS p FROM pos FULL JOIN nm USING (i, gene))", "t AS (SELECT i, sum(p) AS t, sum(p * ln(p)) AS pl, count(*) AS n FROM l WHERE p > 0 GROUP BY 1)",
"s AS (SELECT i, least(greatest(CASE WHEN n > 1 THEN -(pl / t - ln(t)) / ln(n) ELSE 0 END, 0), 1) AS score FROM t)", "q AS (SELECT quantile_cont(score, 0.05) AS q FROM s)") + "SELECT i, round(score, 6) AS score, score < q AS flag FROM s, q")
def spatial_entropy_qc(s, d):
    return rounded(qc.spatial_entropy_qc(positive(s, d), graph.knn(A.points(s, d), 6)), "score")


@entry("neighbor_discordance_qc", with_("pts", "val", POS, knn_sql(6), "nm AS (SELECT k.i, p.gene, sum(p.v) / 6 AS m FROM knn k JOIN pos p ON k.j = p.i GROUP BY 1, 2)",
"b AS (SELECT i, gene, coalesce(v, 0) AS v, coalesce(m, 0) AS m FROM pos FULL JOIN nm USING (i, gene))", "c AS (SELECT i, v / sum(v) OVER (PARTITION BY i) AS p, m / sum(m) OVER (PARTITION BY i) AS q FROM b)",
"s AS (SELECT i, least(greatest(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / (0.5 * (p + q))) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / (0.5 * (p + q))) ELSE 0 END) / ln(2), 0), 1) AS score FROM c GROUP BY i)", "q AS (SELECT quantile_cont(score, 0.95) AS t FROM s)") + "SELECT i, round(score, 6) AS score, score > t AS flag FROM s, q")
def neighbor_discordance_qc(s, d):
    return rounded(qc.neighbor_discordance_qc(positive(s, d), graph.knn(A.points(s, d), 6)), "score")


def _norm(name: str, f, sql: str) -> None:
    entry(name, with_("expr", "var") + sql)(lambda s, d: rounded(f(A.expr(s, d)), "value"))


_norm("library_size_scale", normalize.library_size_scale, "SELECT obs_id, gene_id, round(value * 10000 / sum(value) OVER (PARTITION BY obs_id), 6) AS value FROM expr")
_norm("log1p_cp10k", normalize.log1p_cp10k, "SELECT obs_id, gene_id, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY obs_id)), 6) AS value FROM expr")
_norm("sqrt_transform", normalize.sqrt_transform, "SELECT obs_id, gene_id, round(sqrt(value), 6) AS value FROM expr")
_norm("arcsinh_transform", normalize.arcsinh_transform, "SELECT obs_id, gene_id, round(asinh(value / 5), 6) AS value FROM expr")
_norm("tfidf_l2", normalize.tfidf_l2, """, idf AS (SELECT gene_id, ln(1 + (SELECT count(DISTINCT obs_id) FROM expr) / (1.0 + count(*))) AS idf FROM expr WHERE value > 0 GROUP BY 1),
w AS (SELECT obs_id, gene_id, value / sum(value) OVER (PARTITION BY obs_id) * idf AS w FROM expr JOIN idf USING (gene_id))
SELECT obs_id, gene_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY obs_id)), 6) AS value FROM w""")
_norm("rank_stabilize", normalize.rank_stabilize, "SELECT obs_id, gene_id, round((rank() OVER (PARTITION BY obs_id ORDER BY value) + (count(*) OVER (PARTITION BY obs_id, value) - 1) / 2.0) / count(*) OVER (PARTITION BY obs_id), 6) AS value FROM expr WHERE value > 0")


@entry("clr_per_cell", with_("expr", "var", "nv AS (SELECT count(*) AS nv FROM var)", "m AS (SELECT obs_id, gene_id, ln(value + 1) AS l, sum(ln(value + 1)) OVER (PARTITION BY obs_id) / nv AS mean FROM expr, nv)") + "SELECT obs_id, gene_id, round(l - mean, 6) AS value, round(-mean, 6) AS zero_value FROM m")
def clr_per_cell(s, d):
    return rounded(normalize.clr_per_cell(A.expr(s, d), n_vars(s, d)), "value", "zero_value")


@entry("robust_pearson_residual", with_("expr", "var", "p AS (SELECT obs_id, gene_id, value, sum(value) OVER (PARTITION BY obs_id) * (sum(value) OVER (PARTITION BY gene_id) + 1) / (sum(value) OVER () + (SELECT count(*) FROM var)) AS mu FROM expr)") + "SELECT obs_id, gene_id, round(least(greatest((value - mu) / sqrt(mu + mu * mu / 100), -10), 10), 6) AS value, round(mu, 6) AS expected FROM p")
def robust_pearson_residual(s, d):
    return rounded(normalize.robust_pearson_residual(A.expr(s, d), n_vars(s, d)), "value", "expected")


@entry("pearson_residuals", with_("val", "cnt", "n10 AS (SELECT i, gene, floor(10 * v) AS v FROM cnt)", "p AS (SELECT i, gene, v, sum(v) OVER (PARTITION BY i) * (sum(v) OVER (PARTITION BY gene) + 1) / (sum(v) OVER () + 62) AS mu FROM n10)") + "SELECT i, gene, round(CASE WHEN mu > 0 THEN least(greatest((v - mu) / sqrt(mu + mu * mu / 100), -10), 10) ELSE 0 END, 6) AS v FROM p")
def pearson_residuals(s, d):
    """Tenths as counts, of which many are zero."""
    return rounded(normalize.pearson_residuals(A.counts(s, d).withColumn("v", F.floor(10 * F.col("v")).cast("double"))), "v")


@entry("spatial_median_normalize", with_("pts", "val", POS, knn_sql(6), "t AS (SELECT i, sum(v) AS t FROM pos GROUP BY 1)", "a AS (SELECT i, t FROM t UNION ALL SELECT k.i, t.t FROM knn k JOIN t ON k.j = t.i)", "m AS (SELECT i, median(t) AS m FROM a GROUP BY 1)") + "SELECT p.i, gene, round(v * 10000 / (0.5 * t + 0.5 * m), 4) AS v FROM pos p JOIN t USING (i) JOIN m USING (i)")
def spatial_median_normalize(s, d):
    return rounded(normalize.spatial_median_normalize(positive(s, d), graph.knn(A.points(s, d), 6)), "v", dp=4)


@entry("graph_diffusion_normalize", with_("pts", "val", POS, knn_sql(6), "s0 AS (SELECT i, gene, ln(1 + v * 10000 / sum(v) OVER (PARTITION BY i)) AS v FROM pos)",
"s1 AS (SELECT a.i, a.gene, 0.75 * any_value(a.v) + 0.25 * avg(b.v) AS v FROM s0 a JOIN knn k ON a.i = k.i JOIN s0 b ON k.j = b.i AND a.gene = b.gene GROUP BY 1, 2)", "s2 AS (SELECT a.i, a.gene, 0.75 * any_value(a.v) + 0.25 * avg(b.v) AS v FROM s1 a JOIN knn k ON a.i = k.i JOIN s1 b ON k.j = b.i AND a.gene = b.gene GROUP BY 1, 2)") + "SELECT i, gene, round(v, 6) AS v FROM s2")
def graph_diffusion_normalize(s, d):
    return rounded(normalize.graph_diffusion_normalize(positive(s, d), graph.knn(A.points(s, d), 6)), "v")


@entry("knn_graph", with_("pts", knn_sql(6)) + "SELECT i, j, CAST(r AS INTEGER) AS r, round(d2, 9) AS d2 FROM knn")
def knn_graph(s, d):
    return rounded(graph.knn(A.points(s, d), 6), "d2", dp=9)


RAD = "rad AS (SELECT a.i, b.i AS j, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM pts a JOIN pts b ON a.i < b.i WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 0.02*0.02)"


@entry("radius_graph", with_("pts", RAD) + "SELECT i, j, round(d2, 9) AS d2 FROM rad")
def radius_graph(s, d):
    return rounded(graph.radius_graph(A.points(s, d), 0.02), "d2", dp=9)


@entry("mutual_knn_graph", with_("pts", knn_sql(6), "m AS (SELECT a.i, a.j, sqrt(a.d2) AS d FROM knn a JOIN knn b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j)") + "SELECT i, j, round(exp(-d / (SELECT median(d) FROM m)), 6) AS weight FROM m")
def mutual_knn_graph(s, d):
    return rounded(graph.mutual(graph.knn(A.points(s, d), 6)), "weight")


@entry("adaptive_radius_graph", with_("pts", knn_sql(6), "rr AS (SELECT i, sqrt(d2) * 1.25 AS radius FROM knn WHERE r = 6)", "b AS (SELECT a.i, c.i AS j, (a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y) AS d2, p.radius, (p.radius + q.radius) / 2 AS sigma FROM pts a JOIN rr p ON a.i = p.i JOIN pts c ON a.i <> c.i JOIN rr q ON c.i = q.i)") + "SELECT least(i, j) AS i, greatest(i, j) AS j, round(max(exp(-d2 / (2 * sigma * sigma))), 6) AS weight FROM b WHERE sqrt(d2) <= radius GROUP BY 1, 2")
def adaptive_radius_graph(s, d):
    return rounded(graph.adaptive_radius(A.points(s, d), 6), "weight")


VEC = "vec AS (SELECT i, x, y, list_transform(range(3, 11), lambda g: CAST(embedding[g] AS DOUBLE)) AS v FROM pts JOIN embeddings ON i = vec_id)"
PAIRS = "pd AS (SELECT a.i, b.i AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS ds, list_distance(a.v, b.v) AS de FROM vec a JOIN vec b ON a.i <> b.i)"


def vectors(s, d) -> DataFrame:
    """Eight components of an embedding, in the place of principal components."""
    return A.table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform(F.slice("embedding", 3, 8), lambda x: x.cast("double")).alias("vec"))


@entry("expression_spatial_graph", with_("pts", VEC, PAIRS, knn_sql(6), "ks AS (SELECT median(sqrt(d2)) AS s FROM knn WHERE d2 > 0)", "ke AS (SELECT median(de) AS e FROM (SELECT de FROM pd QUALIFY row_number() OVER (PARTITION BY i ORDER BY de, j) <= 6) WHERE de > 0)",
"f AS (SELECT i, j, 0.5 * ds / s + 0.5 * de / e AS d FROM pd, ks, ke)", "n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 6)") + "SELECT least(i, j) AS i, greatest(i, j) AS j, round(max(exp(-d)), 6) AS weight FROM n GROUP BY 1, 2")
def expression_spatial_graph(s, d):
    return rounded(graph.fused_graph(A.points(s, d), vectors(s, d)), "weight")


SYM = "sym AS (SELECT i, j FROM knn UNION SELECT j, i FROM knn)"


@entry("graph_clustering", with_("pts", knn_sql(6), SYM, "dg AS (SELECT i, count(*) AS degree FROM sym GROUP BY 1)", "tr AS (SELECT a.i, count(*) // 2 AS triangles FROM sym a JOIN sym b ON a.i = b.i AND a.j <> b.j JOIN sym c ON a.j = c.i AND b.j = c.j GROUP BY 1)") + "SELECT i, degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM dg LEFT JOIN tr USING (i)")
def graph_clustering(s, d):
    return rounded(graph.clustering(graph.knn(A.points(s, d), 6)), "coefficient")


@entry("graph_components", "WITH RECURSIVE " + with_("pts", RAD, "sym AS (SELECT i, j FROM rad UNION SELECT j, i FROM rad)", "walk AS (SELECT i, i AS c FROM sym UNION SELECT s.j, w.c FROM walk w JOIN sym s ON w.i = s.i WHERE w.c < s.j)")[5:] + "SELECT i, min(c) AS component FROM walk GROUP BY 1")
def graph_components(s, d):
    return graph.radius_components(A.points(s, d), 0.02)


@entry("eigenvector_centrality")
def eigenvector_centrality(s, d):
    """Iterative numerics: checked for shape, and in the tests against a dense solution."""
    return rounded(graph.eigenvector_centrality(graph.knn(A.points(s, d), 6)), "centrality")


BOX = "box AS (SELECT c AS label_box, -0.3 + 0.1 * (c % 4) AS x0, -0.3 + 0.1 * (c % 4) + 0.2 AS x1, -0.3 + 0.15 * (c // 4) AS y0, -0.3 + 0.15 * (c // 4) + 0.25 AS y1 FROM (SELECT unnest(range(0, 12)) AS c))"


def boxes(s: SparkSession) -> DataFrame:
    c = F.col("id").cast("int")
    x, y = -0.3 + 0.1 * (c % 4), -0.3 + 0.15 * F.floor(c / 4)
    return s.range(12).select(F.col("id").alias("label_box"), x.alias("x0"), (x + 0.2).alias("x1"), y.alias("y0"), (y + 0.25).alias("y1"))


@entry("points_in_boxes", with_("pts", BOX) + "SELECT i, min(CAST(label_box AS BIGINT)) FILTER (WHERE rk = 1) AS box FROM (SELECT p.i, label_box, row_number() OVER (PARTITION BY p.i ORDER BY (x1-x0)*(y1-y0), label_box) AS rk FROM pts p LEFT JOIN box ON x >= x0 AND x < x1 AND y >= y0 AND y < y1) GROUP BY 1")
def points_in_boxes(s, d):
    return graph.points_in_boxes(A.points(s, d), boxes(s))


@entry("point_in_polygon", with_("pts") + "SELECT i, CASE WHEN abs(x) + abs(y) < 0.1 THEN 0 WHEN abs(x) + abs(y) < 0.2 THEN 1 END AS polygon FROM pts")
def point_in_polygon(s, d):
    """Two diamonds around the origin."""
    ring = lambda r: [(r, 0.0), (0.0, r), (-r, 0.0), (0.0, -r)]
    return graph.point_in_polygon(A.points(s, d), s.createDataFrame([(0, ring(0.1)), (1, ring(0.2))], "label_poly int, ring array<struct<x:double,y:double>>"))


@entry("nearest_centre", with_("pts", "c AS (SELECT label AS centre, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1)") + "SELECT i, centre, round(d2, 9) AS d2 FROM (SELECT i, centre, (x-cx)*(x-cx)+(y-cy)*(y-cy) AS d2 FROM pts, c) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, centre) = 1")
def nearest_centre(s, d):
    p = A.points(s, d)
    return rounded(graph.nearest_centre(p, labels.centroids(p).select(F.col("c").alias("centre"), F.col("cx").alias("x"), F.col("cy").alias("y"))), "d2", dp=9)


PAIR = "pr AS (SELECT k.i, k.j, k.r, a.gene, a.v, b.v AS vj FROM knn k JOIN val a ON k.i = a.i JOIN val b ON k.j = b.i AND a.gene = b.gene)"
Z = "z AS (SELECT i, gene, (ln(1 + v) - avg(ln(1 + v)) OVER (PARTITION BY gene)) / stddev_pop(ln(1 + v)) OVER (PARTITION BY gene) AS v FROM cnt)"
ZP = "zp AS (SELECT k.i, k.j, k.r, a.gene, a.v, b.v AS vj FROM knn k JOIN z a ON k.i = a.i JOIN z b ON k.j = b.i AND a.gene = b.gene)"


@entry("morans_i", with_("pts", "val", knn_sql(6), SYM, "mo AS (SELECT gene, avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS ss FROM val GROUP BY 1)",
"nu AS (SELECT a.gene, sum((a.v - m) * (b.v - m)) AS num FROM sym JOIN val a ON sym.i = a.i JOIN val b ON sym.j = b.i AND a.gene = b.gene JOIN mo ON a.gene = mo.gene GROUP BY 1)",
"sc AS (SELECT gene, n, n / (SELECT count(*) FROM sym)::DOUBLE * num / (ss + 1e-12) AS moran FROM nu JOIN mo USING (gene))", "zz AS (SELECT gene, moran, (moran + 1.0 / (n - 1)) / sqrt(greatest(1e-12, 2.0 / (n * 6))) AS z FROM sc)", f"pp AS (SELECT gene, moran, z, {erfc_sql('(abs(z) / sqrt(2.0))')} AS p FROM zz)") + """
SELECT gene, round(moran, 6) AS morans_i, round(z, 5) AS z, round(p, 6) AS p, round(least(greatest(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 1), 6) AS q
FROM (SELECT *, row_number() OVER (ORDER BY p, gene) AS r, count(*) OVER () AS m FROM pp)""")
def morans_i(s, d):
    out = svg.morans_i(A.values(s, d), graph.knn(A.points(s, d), 6), 6)
    return rounded(rounded(out, "morans_i", "p", "q"), "z", dp=5)


@entry("gearys_c", with_("pts", "val", knn_sql(6), PAIR, "mo AS (SELECT gene, count(*) AS n, var_pop(v) * count(*) AS ss FROM val GROUP BY 1)") + "SELECT gene, round(1 - (any_value(n) - 1) * sum((v - vj) * (v - vj)) / (2.0 * count(*) * any_value(ss)), 6) AS score FROM pr JOIN mo USING (gene) GROUP BY 1")
def gearys_c(s, d):
    return rounded(svg.gearys_c(A.values(s, d), graph.knn(A.points(s, d), 6)), "score")


@entry("spatial_variance_ratio", with_("pts", "val", knn_sql(6), PAIR, "lm AS (SELECT i, gene, avg(vj) AS m, any_value(v) AS v FROM pr GROUP BY 1, 2)") + "SELECT gene, round(var_pop(m) / var_pop(v), 6) AS score FROM lm GROUP BY 1")
def spatial_variance_ratio(s, d):
    return rounded(svg.variance_ratio(A.values(s, d), graph.knn(A.points(s, d), 6)), "score")


@entry("multiscale_svg", with_("pts", "val", "cnt", knn_sql(18), Z, ZP, "lm AS (SELECT i, gene, any_value(v) AS v, avg(vj) FILTER (WHERE r <= 6) AS m1, avg(vj) FILTER (WHERE r <= 12) AS m2, avg(vj) AS m3 FROM zp GROUP BY 1, 2)") + "SELECT gene, round(greatest((avg(v * m1) + avg(v * m2) + avg(v * m3)) / 3, 0), 6) AS score FROM lm GROUP BY 1")
def multiscale_svg(s, d):
    return rounded(svg.multiscale(A.counts(s, d), graph.knn(A.points(s, d), 18), 6), "score")


@entry("boundary_svg", with_("pts", "val", "cnt", knn_sql(6), Z, ZP, "j AS (SELECT i, gene, avg((v - vj) * (v - vj)) AS jump FROM zp GROUP BY 1, 2)", "a AS (SELECT *, avg(jump) OVER (PARTITION BY i) AS al FROM j)") + "SELECT gene, round(greatest(covar_pop(jump, al) / (stddev_pop(jump) * stddev_pop(al)), 0), 6) AS score FROM a GROUP BY 1")
def boundary_svg(s, d):
    return rounded(svg.boundary(A.counts(s, d), graph.knn(A.points(s, d), 6)), "score")


@entry("hotspot_svg", with_("pts", "val", "cnt", knn_sql(6), Z, ZP, "l AS (SELECT i, gene, (any_value(v) + sum(vj)) / 7 AS l FROM zp GROUP BY 1, 2)") + "SELECT gene, round(avg(l * l), 6) AS score FROM l GROUP BY 1")
def hotspot_svg(s, d):
    return rounded(svg.hotspot(A.counts(s, d), graph.knn(A.points(s, d), 6)), "score")


@entry("anisotropy_svg", with_("pts", "val", "cnt", knn_sql(6), Z, ZP, "sec AS (SELECT zp.*, least(floor((atan2(b.y - a.y, b.x - a.x) + CASE WHEN atan2(b.y - a.y, b.x - a.x) < 0 THEN pi() ELSE 0 END) / (pi() / 4)), 3) AS sector FROM zp JOIN pts a ON zp.i = a.i JOIN pts b ON zp.j = b.i)",
"per AS (SELECT i, gene, sector, avg(v * vj) AS m FROM sec GROUP BY 1, 2, 3)", "dir AS (SELECT gene, sector, sum(m) / (SELECT count(*) FROM pts) AS s FROM per GROUP BY 1, 2)") + "SELECT gene, round(max(s) - min(s), 6) AS score FROM dir GROUP BY 1")
def anisotropy_svg(s, d):
    p = A.points(s, d)
    return rounded(svg.anisotropy(A.counts(s, d), graph.knn(p, 6), p), "score")


@entry("bootstrap_robust_svg", with_("pts", "val", "cnt", Z, f"bs AS MATERIALIZED (SELECT b, i, x, y FROM pts, (SELECT unnest(range(12)) AS b) WHERE {crc32_sql("(CAST(b AS VARCHAR) || ':' || CAST(i AS VARCHAR))")} % 1000 < 750)", knn_sql(6, src="bs", part="b").replace("AS (SELECT a.i AS i", "AS MATERIALIZED (SELECT a.b AS b, a.i AS i").replace("PARTITION BY a.i", "PARTITION BY a.b, a.i"),
  "lm AS (SELECT k.b, k.i, x.gene, any_value(x.v) AS v, avg(y.v) AS m FROM knn k JOIN z x ON x.i = k.i JOIN z y ON y.i = k.j AND y.gene = x.gene GROUP BY 1, 2, 3)", "ac AS (SELECT b, gene, avg(v * m) AS a FROM lm GROUP BY 1, 2)")
  + "SELECT gene, round(greatest(avg(a), 0) * avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END) / (1 + stddev_pop(a)), 6) AS score FROM ac GROUP BY 1")
def bootstrap_robust_svg(s, d):
    p = A.points(s, d)
    return rounded(svg.bootstrap_robust(A.counts(s, d), lambda q: graph.knn(q, 6), p), "score")


CT = "ct AS (SELECT label AS truth, pred, count(*) AS n FROM pts GROUP BY 1, 2)"


@entry("contingency_table", with_("pts", CT) + "SELECT truth, pred, n FROM ct")
def contingency_table(s, d):
    return labels.contingency(A.points(s, d))


@entry("adjusted_rand_index", with_("pts", CT, "x AS (SELECT sum(n * (n - 1) / 2.0) AS ij, sum(n) AS n FROM ct)", "a AS (SELECT sum(n * (n - 1) / 2.0) AS a FROM (SELECT sum(n) AS n FROM ct GROUP BY truth))", "b AS (SELECT sum(n * (n - 1) / 2.0) AS b FROM (SELECT sum(n) AS n FROM ct GROUP BY pred))") + "SELECT round((ij - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2.0)), 9) AS ari FROM x, a, b")
def adjusted_rand_index(s, d):
    return rounded(labels.adjusted_rand(labels.contingency(A.points(s, d))), "ari", dp=9)


@entry("normalized_mutual_information", with_("pts", CT, "w AS (SELECT n, sum(n) OVER (PARTITION BY truth) AS t, sum(n) OVER (PARTITION BY pred) AS p, sum(n) OVER () AS a FROM ct)") + "SELECT round(2 * sum(n / a * ln(n * a / (t * p))) / (-sum(n / a * ln(t / a)) - sum(n / a * ln(p / a))), 9) AS nmi FROM (SELECT n::DOUBLE AS n, t::DOUBLE AS t, p::DOUBLE AS p, a::DOUBLE AS a FROM w)")
def nmi(s, d):
    return rounded(labels.normalized_mutual_information(labels.contingency(A.points(s, d))), "nmi", dp=9)


PC = "pc AS (SELECT c AS class, hit, support, coalesce(called, 0) AS called FROM (SELECT truth AS c, sum(n) AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit FROM ct GROUP BY 1) LEFT JOIN (SELECT pred AS c, sum(n) AS called FROM ct GROUP BY 1) USING (c))"
F1 = "f AS (SELECT class, CASE WHEN called > 0 THEN hit / called ELSE 0.0 END AS precision, hit / support AS recall, CASE WHEN hit > 0 THEN 2.0 * hit / (called + support) ELSE 0.0 END AS f1, CAST(support AS BIGINT) AS support FROM pc)"


@entry("class_scores", with_("pts", CT, PC, F1) + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def class_scores(s, d):
    return rounded(labels.per_class(labels.contingency(A.points(s, d))), "precision", "recall", "f1")


@entry("macro_scores", with_("pts", CT, PC, F1) + "SELECT round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS balanced_accuracy FROM f")
def macro_scores(s, d):
    return rounded(labels.macro_scores(labels.contingency(A.points(s, d))), "macro_f1", "balanced_accuracy")


@entry("average_precision", with_("pts", "g AS (SELECT label, x, count(*) AS n, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS tp FROM pts GROUP BY 1, 2)", "c AS (SELECT label, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY label ORDER BY x DESC ROWS UNBOUNDED PRECEDING))") + "SELECT label, round(CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / cn) / sum(tp) ELSE 0 END, 6) AS average_precision FROM c GROUP BY 1")
def average_precision(s, d):
    return rounded(labels.average_precision(A.points(s, d).withColumn("pos", F.col("y") > 0), "x", "pos", "label"), "average_precision")


@entry("auc", with_("evid", "g AS (SELECT score, count(*) AS n, sum(CASE WHEN seed > 50 THEN 1 ELSE 0 END) AS p FROM evid GROUP BY 1)", "r AS (SELECT n, p, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM g)") + "SELECT round((sum(p * rk) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(n - p)), 6) AS auc FROM r")
def auc(s, d):
    return rounded(labels.auc(A.evidence(s, d).withColumn("pos", F.col("seed") > 50), "score", "pos"), "auc")


CEN = "cen AS (SELECT label AS c, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM pts GROUP BY 1)"


@entry("calinski_harabasz", with_("pts", CEN, "w AS (SELECT sum((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS wi, count(*) AS n, (var_pop(x) + var_pop(y)) * count(*) AS tot FROM pts JOIN cen ON label = c)") + "SELECT round(((tot - wi) / ((SELECT count(*) FROM cen) - 1)) / (wi / (n - (SELECT count(*) FROM cen))), 6) AS ch FROM w")
def calinski_harabasz(s, d):
    return rounded(labels.calinski_harabasz(A.points(s, d)), "ch")


@entry("davies_bouldin", with_("pts", CEN, "sp AS (SELECT c, cx, cy, avg(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))) AS s FROM pts JOIN cen ON label = c GROUP BY 1, 2, 3)") + "SELECT round(avg(r), 5) AS db FROM (SELECT a.c, max((a.s + b.s) / sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy))) AS r FROM sp a JOIN sp b ON a.c <> b.c GROUP BY 1)")
def davies_bouldin(s, d):
    return rounded(labels.davies_bouldin(A.points(s, d)), "db", dp=5)


@entry("silhouette", with_("pts", CEN, "dd AS (SELECT i, max(CASE WHEN label = c THEN sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) END) AS a, min(CASE WHEN label <> c THEN sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) END) AS b FROM pts, cen GROUP BY 1)") + "SELECT round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM dd")
def silhouette(s, d):
    return rounded(labels.silhouette_simplified(A.points(s, d)), "silhouette")


@entry("spatial_kappa", with_("pts", knn_sql(6), "o AS (SELECT avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0 END) AS po FROM knn JOIN pts a ON knn.i = a.i JOIN pts b ON knn.j = b.i)", "e AS (SELECT sum(f * f) AS pe FROM (SELECT count(*) / (SELECT count(*) FROM pts)::DOUBLE AS f FROM pts GROUP BY label))") + "SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM o, e")
def spatial_kappa(s, d):
    p = A.points(s, d)
    return rounded(labels.spatial_kappa(graph.knn(p, 6), p), "kappa")


@entry("neighbour_entropy", with_("pts", knn_sql(6), "c AS (SELECT knn.i, label, count(*) / 6.0 AS p FROM knn JOIN pts b ON knn.j = b.i GROUP BY 1, 2)") + "SELECT i, round(-sum(p * log2(p)) + 0.0, 6) AS entropy FROM c GROUP BY 1")
def neighbour_entropy(s, d):
    p = A.points(s, d)
    return rounded(labels.neighbour_entropy(graph.knn(p, 6), p), "entropy")


@entry("boundary_f1", with_("pts", knn_sql(6), "e AS (SELECT a.label <> b.label AS a, a.pred <> b.pred AS b FROM knn JOIN pts a ON knn.i = a.i JOIN pts b ON knn.j = b.i)") + "SELECT round(2.0 * count(*) FILTER (WHERE a AND b) / (2 * count(*) FILTER (WHERE a AND b) + count(*) FILTER (WHERE a <> b)), 6) AS boundary_f1 FROM e")
def boundary_f1(s, d):
    p = A.points(s, d)
    return rounded(labels.boundary_f1(graph.knn(p, 6), p), "boundary_f1")


@entry("cluster_markers", with_("pts", "val", "g AS (SELECT label AS l, gene, sum(v) AS s, count(*) AS n FROM val JOIN pts USING (i) GROUP BY 1, 2)", "dd AS (SELECT l, gene, s / n - (sum(s) OVER w - s) / (sum(n) OVER w - n) AS diff FROM g WINDOW w AS (PARTITION BY gene))") + "SELECT l, gene, round(diff, 6) AS diff, CAST(row_number() OVER (PARTITION BY l ORDER BY round(diff, 9) DESC, gene) AS INTEGER) AS rank FROM dd QUALIFY row_number() OVER (PARTITION BY l ORDER BY round(diff, 9) DESC, gene) <= 2")
def cluster_markers(s, d):
    return rounded(labels.top_markers(A.values(s, d), A.points(s, d).select("i", F.col("label").alias("l"))), "diff")


MK = "mk AS (SELECT gene // 5 AS label, gene FROM (SELECT unnest(range(3, 9)) AS gene))"
MS = "ms AS (SELECT i, label, avg((v - m) / (sd + 1e-8)) AS s FROM val JOIN (SELECT gene, avg(v) AS m, stddev_pop(v) AS sd FROM val GROUP BY 1) USING (gene) JOIN mk USING (gene) GROUP BY 1, 2)"


def markers(s: SparkSession) -> DataFrame:
    return s.range(3, 9).select(F.floor(F.col("id") / 5).alias("label"), F.col("id").cast("int").alias("gene"))


def _annotated(src: str) -> str:
    return f"SELECT i, max(CASE WHEN r = 1 THEN label END) AS cell_type, round(max(CASE WHEN r = 1 THEN s END), 6) AS score, round(max(CASE WHEN r = 1 THEN s END) - max(CASE WHEN r = 2 THEN s END), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, label) AS r FROM {src}) GROUP BY 1"


@entry("marker_score", with_("val", MK, MS) + _annotated("ms"))
def marker_score(s, d):
    return rounded(labels.annotate(labels.marker_scores(A.values(s, d), markers(s))), "score", "margin")


SM = "sm AS (SELECT a.i, a.label, 0.65 * any_value(a.s) + 0.35 * avg(b.s) AS s FROM ms a JOIN knn k ON a.i = k.i JOIN ms b ON k.j = b.i AND a.label = b.label GROUP BY 1, 2)"


@entry("neighbor_marker_annotate", with_("pts", "val", MK, MS, knn_sql(6), SM) + _annotated("sm"))
def neighbor_marker_annotate(s, d):
    sc = labels.marker_scores(A.values(s, d), markers(s))
    return rounded(labels.annotate(labels.smoothed_scores(sc, graph.knn(A.points(s, d), 6))), "score", "margin")


PROP = "pp AS (SELECT i, label, exp(s) / sum(exp(s)) OVER (PARTITION BY i) AS p FROM ms)"


@entry("marker_deconv", with_("val", MK, MS, PROP) + "SELECT i, label, round(p, 6) AS p FROM pp")
def marker_deconv(s, d):
    return rounded(labels.proportions(labels.marker_scores(A.values(s, d), markers(s))), "p")


EVID = """ev AS (SELECT i, label, CASE WHEN sum(e) OVER (PARTITION BY i) > 0 THEN e / sum(e) OVER (PARTITION BY i) ELSE 0.5 END AS p FROM (SELECT i, label, avg(ln(1 + v)) AS e FROM cnt JOIN mk USING (gene) GROUP BY 1, 2)),
w1 AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(exp(-sqrt(d2) / (SELECT median(sqrt(d2)) FROM knn WHERE d2 > 0))) AS w FROM knn GROUP BY 1, 2),
ww AS (SELECT i, j, w FROM w1 UNION ALL SELECT j, i, w FROM w1), dg AS (SELECT i, sum(w) AS g FROM ww GROUP BY 1), sz AS (SELECT 1.0 / (1 + max(g)) AS h FROM dg)"""


def _step(src: str, out: str) -> str:
    """One projected step; of two shares the nearest point with sum one moves both by half of what is missing."""
    free = f"SELECT a.i, a.label, a.p - h * (a.p - ev.p + 0.5 * (g * a.p - n.s)) AS q FROM {src} a JOIN ev USING (i, label) JOIN dg USING (i) JOIN (SELECT ww.i, b.label, sum(w * b.p) AS s FROM ww JOIN {src} b ON ww.j = b.i GROUP BY 1, 2) n ON a.i = n.i AND a.label = n.label, sz"
    return f"{out} AS (SELECT i, label, least(greatest(q + (1 - sum(q) OVER (PARTITION BY i)) / 2, 0), 1) AS p FROM ({free}))"


def batches(s, d) -> DataFrame:
    return A.points(s, d).select("i", (F.col("i") % 3).cast("int").alias("batch"))


BV = "bv AS (SELECT i, gene, v, CAST(i % 3 AS INTEGER) AS batch FROM val)"


@entry("combat", with_("val", BV, "ce AS (SELECT batch, gene, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s FROM bv GROUP BY 1, 2)", "gr AS (SELECT gene, avg(v) AS g, var_samp(v) + 1e-8 AS w FROM bv GROUP BY 1)")
  + "SELECT i, gene, round((v - m) / sqrt(s + 1e-8) / sqrt((n * (s / (s + 1e-8) + 1e-8) + 4) / (n + 4)) * sqrt(w) + g, 6) AS v FROM bv JOIN ce USING (batch, gene) JOIN gr USING (gene)")
def combat(s, d):
    return rounded(integrate.combat(A.values(s, d), batches(s, d)), "v")


@entry("combat_ranks", with_("val", BV, "qu AS (SELECT i, gene, ((rank() OVER (PARTITION BY gene, batch ORDER BY v) + (count(*) OVER (PARTITION BY gene, batch, v) - 1) / 2.0) - 0.5) / count(*) OVER (PARTITION BY gene, batch) * (count(*) OVER (PARTITION BY gene) - 1) AS p, count(*) OVER (PARTITION BY gene) AS n FROM bv)",
  "po AS (SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY v, i) - 1 AS k, v AS q FROM bv)") + "SELECT qu.i, qu.gene, round(a.q + (b.q - a.q) * (p - floor(p)), 6) AS v FROM qu JOIN po a ON a.gene = qu.gene AND a.k = CAST(floor(p) AS BIGINT) JOIN po b ON b.gene = qu.gene AND b.k = least(CAST(floor(p) AS BIGINT) + 1, n - 1)")
def combat_ranks(s, d):
    return rounded(integrate.combat_ranks(A.values(s, d), batches(s, d)), "v")


@entry("quantile_integrate", with_("pts", "val", BV, "rk AS (SELECT i, batch, gene, v, row_number() OVER (PARTITION BY batch, gene ORDER BY v, i) AS pos, (rank() OVER (PARTITION BY batch, gene ORDER BY v) + (count(*) OVER (PARTITION BY batch, gene, v) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY batch, gene) AS u FROM bv)",
"sz AS (SELECT batch AS other, gene, count(*) AS m FROM bv GROUP BY 1, 2)", "ak AS (SELECT i, batch, gene, other, u * (m - 1) AS place, CAST(floor(u * (m - 1)) AS BIGINT) + 1 AS lo, least(CAST(floor(u * (m - 1)) AS BIGINT) + 2, m) AS hi FROM rk JOIN sz USING (gene))",
"vl AS MATERIALIZED (SELECT gene, batch AS other, pos, v FROM rk)", "a1 AS (SELECT ak.*, vl.v AS va FROM ak JOIN vl ON vl.gene = ak.gene AND vl.other = ak.other AND vl.pos = ak.lo)", "aq AS (SELECT a1.i, a1.batch, a1.gene, avg(va + (place - floor(place)) * (vl.v - va)) AS v FROM a1 JOIN vl ON vl.gene = a1.gene AND vl.other = a1.other AND vl.pos = a1.hi GROUP BY 1, 2, 3)",
"bp AS (SELECT i, x, y, CAST(i % 3 AS INTEGER) AS batch FROM pts)", knn_sql(6, src="bp", part="batch"), "lm AS (SELECT knn.i, gene, avg(v) AS m FROM knn JOIN aq ON knn.j = aq.i GROUP BY 1, 2)") + "SELECT aq.i, aq.gene, round(0.8 * v + 0.2 * coalesce(m, v), 6) AS v FROM aq LEFT JOIN lm ON aq.i = lm.i AND aq.gene = lm.gene")
def quantile_integrate(s, d):
    return rounded(integrate.quantile_align(A.values(s, d), batches(s, d), A.points(s, d)), "v")


@entry("anchor_residual_integrate", with_("pts", "val", BV, VEC, "rf AS (SELECT batch FROM (SELECT CAST(i % 3 AS INTEGER) AS batch FROM pts) GROUP BY 1 ORDER BY count(*) DESC, batch LIMIT 1)", "bt AS (SELECT *, CAST(i % 3 AS INTEGER) AS batch, row_number() OVER (PARTITION BY i % 3 ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY i % 3) AS n FROM vec)",
"sm AS (SELECT * FROM bt WHERE n <= 256 OR pos IN (SELECT CAST(floor(k * (n - 1) / 255.0 + 1e-9) AS BIGINT) FROM (SELECT unnest(range(0, 256)) AS k)))", "sc AS (SELECT a.batch, median(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS s, median(list_distance(a.v, b.v)) AS e FROM sm a JOIN sm b ON a.batch <> b.batch AND b.batch = (SELECT batch FROM rf) GROUP BY 1)",
"f AS (SELECT a.batch, a.i, b.i AS j, list_distance(a.v, b.v) / e + sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / s AS d FROM bt a JOIN sc ON a.batch = sc.batch JOIN bt b ON b.batch = (SELECT batch FROM rf))",
"an AS (SELECT o.batch, o.i, o.j FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1) o JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY batch, j ORDER BY d, i) = 1) t ON o.i = t.i AND o.j = t.j)",
"sh AS (SELECT an.batch, a.gene, median(a.v - b.v) AS shift FROM an JOIN bv a ON an.i = a.i JOIN bv b ON an.j = b.i AND a.gene = b.gene GROUP BY 1, 2)") + "SELECT bv.i, bv.gene, round(v - coalesce(shift, 0), 6) AS v FROM bv LEFT JOIN sh ON bv.batch = sh.batch AND bv.gene = sh.gene")
def anchor_residual_integrate(s, d):
    return rounded(integrate.anchor_residuals(A.values(s, d), batches(s, d), A.points(s, d), vectors(s, d)), "v")


@entry("median_shift_integrate", with_("val", BV, "rf AS (SELECT batch FROM bv GROUP BY 1 ORDER BY count(DISTINCT i) DESC, batch LIMIT 1)", "md AS (SELECT batch, gene, median(v) AS med FROM bv GROUP BY 1, 2)", "sh AS (SELECT a.batch, a.gene, a.med - b.med AS shift FROM md a JOIN md b ON a.gene = b.gene AND b.batch = (SELECT batch FROM rf))") + "SELECT i, gene, round(v - shift, 6) AS v FROM bv JOIN sh USING (batch, gene)")
def median_shift_integrate(s, d):
    return rounded(integrate.centre_batches(A.values(s, d), batches(s, d)), "v")


@entry("stratified_sample", with_("pts", "q AS (SELECT label, greatest(1, round(count(*) / (SELECT count(*) FROM pts)::DOUBLE * 50)) AS quota FROM pts GROUP BY 1)") + "SELECT i, x, y, label, pred FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(i AS VARCHAR)), i) AS rk FROM pts) JOIN q USING (label) WHERE rk <= quota")
def stratified_sample(s, d):
    return labels.stratified_sample(A.points(s, d), "label", "i", 50).select("i", "x", "y", "label", "pred")
