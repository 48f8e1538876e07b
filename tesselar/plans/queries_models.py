"""Registered queries of clusterings, features, generators and files. Iterated numerics are checked for shape."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import domains as D
from ..operators import features as X
from ..operators import graph, qc
from ..sources import bundle, longtable, synthetic
from . import adapters as A
from .adapters import with_
from .tables import shared_dir
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


def _edges(s, d, k=6):
    return graph.knn(A.points(s, d), k)


def _emb(s, d):
    return D.embedding(A.values(s, d), _edges(s, d))


for _name, _f in {
    "kmeans_domains": D.kmeans, "minibatch_kmeans_domains": D.minibatch_kmeans, "bisecting_kmeans_domains": D.bisecting_kmeans, "gaussian_mixture_domains": D.gaussian_mixture,
    "agglomerative_domains": lambda e: D.warded(e, 3), "birch_domains": lambda e: D.per_sample(e, D.birch(3)), "mean_shift_domains": D.mean_shifted, "optics_domains": lambda e: D.per_sample(e, D.optics()),
}.items():
    entry(_name)(lambda s, d, f=_f: f(_emb(s, d)))


@entry("spectral_domains")
def spectral_domains(s, d):
    return D.spectral(_edges(s, d))


EPS = 0.02


@entry("dbscan_domains", "WITH RECURSIVE " + with_("pts", f"nb AS (SELECT a.i, b.i AS j FROM pts a JOIN pts b ON a.i <> b.i AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {EPS}*{EPS})", "core AS (SELECT i FROM nb GROUP BY 1 HAVING count(*) + 1 >= 4)",
"walk AS (SELECT i, i AS c FROM core UNION SELECT n.j, w.c FROM walk w JOIN nb n ON w.i = n.i JOIN core k ON n.j = k.i WHERE w.c < n.j)", "cl AS (SELECT i, min(c) AS c FROM walk GROUP BY 1)", "bd AS (SELECT n.i, min(c) AS c FROM nb n JOIN cl ON n.j = cl.i GROUP BY 1)")[5:] + "SELECT p.i, coalesce(cl.c, bd.c) AS domain FROM pts p LEFT JOIN cl ON p.i = cl.i LEFT JOIN bd ON p.i = bd.i")
def dbscan_domains(s, d):
    return D.dbscan(A.points(s, d), EPS, 4)


@entry("multiscale_consensus_domains")
def multiscale_consensus_domains(s, d):
    return D.multiscale_consensus(A.counts(s, d), _edges(s, d, 16), 4)


@entry("boundary_aware_domains")
def boundary_aware_domains(s, d):
    return rounded(D.boundary_aware(A.counts(s, d), _edges(s, d, 8)), "boundary")


@entry("uncertainty_domains")
def uncertainty_domains(s, d):
    return D.uncertainty(D.joint_embedding(A.counts(s, d), _edges(s, d, 8)))


@entry("topology_regularized_domains")
def topology_regularized_domains(s, d):
    e = _edges(s, d, 8)
    emb = D.expression_embedding(A.counts(s, d))
    return rounded(D.potts_refined(emb, D.kmeans(emb), e), "coherence")


@entry("azimuthal_feature_domains")
def azimuthal_feature_domains(s, d):
    return D.kmeans(D.saved(D.azimuthal_features(A.values(s, d), _edges(s, d), A.points(s, d)), "azimuthal"))


@entry("expression_features", with_("expr", "var", "s AS (SELECT obs_id, sum(value) AS t, count(*) AS g FROM expr GROUP BY 1)", "gs AS (SELECT sum(value) / (SELECT sum(value) FROM expr) AS p FROM expr GROUP BY gene_id)") + "SELECT count(*) AS n_obs, round(avg(t), 6) AS mean_depth, round(stddev_pop(t) / avg(t), 6) AS cv_depth, round(avg(g), 6) AS mean_genes, round((SELECT -sum(p * log2(p)) FROM gs), 6) AS gene_entropy, (SELECT count(*) FROM var) AS n_genes, round(sum(g) / (count(*) * (SELECT count(*) FROM var))::DOUBLE, 9) AS density FROM s")
def expression_features(s, d):
    out = X.expression_features(A.expr(s, d), A.var(s, d).agg(F.count("*")))
    return rounded(rounded(out, "mean_depth", "cv_depth", "mean_genes", "gene_entropy"), "density", dp=9)


@entry("grid_features", with_("pts", "b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts)", "g AS (SELECT least(floor((x - x0) / (x1 - x0) * 10), 9) AS cx, least(floor((y - y0) / (y1 - y0) * 10), 9) AS cy, count(*) AS n FROM pts, b GROUP BY 1, 2)", "p AS (SELECT n, n / sum(n) OVER ()::DOUBLE AS p FROM g)") + "SELECT round(stddev_pop(n) / avg(n), 6) AS density_cv, round(-sum(p * log2(p)), 6) AS grid_entropy FROM p")
def grid_features(s, d):
    return rounded(X.grid_features(A.points(s, d)), "density_cv", "grid_entropy")


@entry("gram_matrix", with_("val", "c AS (SELECT i, gene, v - avg(v) OVER (PARTITION BY gene) AS v FROM val)") + "SELECT a.gene AS g, b.gene AS h, round(sum(a.v * b.v), 6) AS s FROM c a JOIN c b ON a.i = b.i AND a.gene <= b.gene GROUP BY 1, 2")
def gram_matrix(s, d):
    return rounded(X.gram(A.values(s, d)), "s")


@entry("top_variance_genes", with_("val") + "SELECT gene, round(var_pop(v), 6) AS variance FROM val GROUP BY 1 ORDER BY round(var_pop(v), 9) DESC, gene LIMIT 3")
def top_variance_genes(s, d):
    return rounded(X.top_variance_genes(A.values(s, d), 3), "variance")


@entry("mean_neighbour_distance", with_("pts", A.knn_sql(6)) + "SELECT round((SELECT avg(sqrt(d2)) FROM knn) / sqrt((max(x) - min(x)) * (max(y) - min(y))), 6) AS mean_distance FROM pts")
def mean_neighbour_distance(s, d):
    p = A.points(s, d)
    m = graph.knn(p, 6).agg(F.avg(F.sqrt("d2")).alias("m"))
    a = p.agg(F.sqrt((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("a"))
    return rounded(m.crossJoin(a).select((F.col("m") / F.col("a")).alias("mean_distance")), "mean_distance")


BIN = "b AS (SELECT i, label, ntile(4) OVER (ORDER BY x, i) * 4 + ntile(4) OVER (ORDER BY y, i) AS cell FROM pts)"


def _mi(src: str) -> str:
    return f"(SELECT sum(n / a * ln(n * a / (nc * nl))) FROM (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY cell)::DOUBLE AS nc, sum(n) OVER (PARTITION BY label)::DOUBLE AS nl, sum(n) OVER ()::DOUBLE AS a FROM (SELECT cell, label, count(*) AS n FROM {src} GROUP BY 1, 2)))"


@entry("spatial_information_ratio", with_("pts", BIN, "sh AS (SELECT label, row_number() OVER (ORDER BY md5(CAST(i AS VARCHAR)), i) AS r FROM b)", "ce AS (SELECT cell, row_number() OVER (ORDER BY i) AS r FROM b)", "nu AS (SELECT cell, label FROM sh JOIN ce USING (r))", f"m AS (SELECT {_mi('b')} AS mi, {_mi('nu')} AS null_mi)") + "SELECT round(mi, 6) AS mi, round(null_mi, 6) AS null_mi, round(CASE WHEN mi > 0 THEN (mi - null_mi) / mi ELSE 0 END, 5) AS ratio FROM m")
def spatial_information_ratio(s, d):
    return rounded(rounded(X.spatial_information_ratio(A.points(s, d)), "mi", "null_mi"), "ratio", dp=5)


def _patches(s, d):
    """Image patches of the points: pixels stand on their plane."""
    p = A.points(s, d)
    at = lambda c: s.range(120).select((F.col("id") * 0.005 - 0.3).alias(c))
    px = at("px").crossJoin(F.broadcast(at("py"))).withColumn("band", F.sin(20 * F.col("px")) + F.cos(20 * F.col("py")))  # a picture of fixed size
    return X.patch_features(px, p, 0.05).select("i", F.array(F.coalesce("mean", F.lit(0.0)), F.coalesce("sd", F.lit(0.0))).alias("vec")), p


for _family in ("morphology", "scellst", "storm"):

    def _virtual(s, d, family=_family):
        """Image patches to expression; systems are solved on the driver, and in the tests against a loop."""
        f, p = _patches(s, d)
        return rounded(X.virtual_expression(f, p, A.counts(s, d), family), "v")

    entry(f"virtual_{_family}")(_virtual)


FEATURES = """t AS (SELECT obs_id, sum(value) AS t, count(*) FILTER (WHERE value > 0) AS g FROM expr GROUP BY 1), g AS (SELECT sum(value) AS s FROM expr GROUP BY gene_id), e AS (SELECT -sum(s / tot * log2(s / tot)) AS h FROM g, (SELECT sum(s) AS tot FROM g)),
lb AS (SELECT label, count(*) / (SELECT count(*) FROM pts)::DOUBLE AS p FROM pts GROUP BY 1), ones AS (SELECT i, lb.label AS gene, CASE WHEN pts.label = lb.label THEN 1.0 ELSE 0.0 END AS v FROM pts, lb),
tg AS (SELECT gene FROM cnt GROUP BY 1 ORDER BY round(var_pop(v), 9) DESC, gene LIMIT 10), mo AS (SELECT gene, avg(v) AS m, var_pop(v) * count(*) AS ss, count(*) AS n FROM cnt JOIN tg USING (gene) GROUP BY 1),
mi AS (SELECT avg(n / (SELECT count(*) FROM sym)::DOUBLE * num / (ss + 1e-12)) AS m FROM mo JOIN (SELECT a.gene, sum((a.v - m) * (b.v - m)) AS num FROM sym JOIN cnt a ON sym.i = a.i JOIN cnt b ON sym.j = b.i AND a.gene = b.gene JOIN mo ON a.gene = mo.gene GROUP BY 1) USING (gene)),
om AS (SELECT gene, avg(v) AS m, var_pop(v) * count(*) AS ss, count(*) AS n FROM ones GROUP BY 1),
co AS (SELECT avg(n / (SELECT count(*) FROM sym)::DOUBLE * num / (ss + 1e-12)) AS m FROM om JOIN (SELECT a.gene, sum((a.v - m) * (b.v - m)) AS num FROM sym JOIN ones a ON sym.i = a.i JOIN ones b ON sym.j = b.i AND a.gene = b.gene JOIN om ON a.gene = om.gene GROUP BY 1) USING (gene)),
bb AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), gr AS (SELECT least(floor((x - x0) / (x1 - x0) * 10), 9) AS cx, least(floor((y - y0) / (y1 - y0) * 10), 9) AS cy, count(*) AS n FROM pts, bb GROUP BY 1, 2)"""


@entry("dataset_features_plain", with_("expr", "var", "pts", "val", "cnt", A.knn_sql(6), "sym AS (SELECT i, j FROM knn UNION SELECT j, i FROM knn)", FEATURES) + """SELECT CAST(count(*) AS DOUBLE) AS n_obs, CAST((SELECT count(*) FROM var) AS DOUBLE) AS n_vars, round((SELECT count(*) FROM var) / count(*)::DOUBLE, 6) AS aspect_ratio, round(1 - sum(g) / (count(*) * (SELECT count(*) FROM var))::DOUBLE, 9) AS sparsity,
round(sum(t) / sum(g)::DOUBLE, 6) AS mean_nonzero, round(avg(t), 6) AS library_mean, round(stddev_pop(t) / (avg(t) + 1e-8), 6) AS library_cv, (SELECT round(h, 6) FROM e) AS expression_entropy, (SELECT round(m, 6) FROM mi) AS spatial_autocorrelation,
(SELECT round((SELECT avg(sqrt(d2)) FROM knn) / (sqrt((x1 - x0) * (y1 - y0)) + 1e-12), 6) FROM bb) AS mean_nn_distance, (SELECT round(stddev_pop(n) / avg(n), 6) FROM gr) AS spatial_density_cv, (SELECT round(-sum(n / c::DOUBLE * log2(n / c::DOUBLE)), 6) FROM gr, (SELECT count(*) AS c FROM pts)) AS spatial_entropy,
(SELECT CAST(count(*) AS DOUBLE) FROM lb) AS n_domains, (SELECT round(-sum(p * ln(p)) / ln(count(*)), 6) FROM lb) AS domain_balance, (SELECT round(m, 6) FROM co) AS domain_spatial_coherence FROM t""")
def dataset_features_plain(s, d):
    """The features that SQL can follow."""
    p = A.points(s, d)
    out = X.dataset_features(A.expr(s, d), A.var(s, d), p, A.counts(s, d), p.select("i", "label"), geometry=False)
    return rounded(rounded(out, *[c for c in out.columns if c not in ("n_obs", "n_vars", "sparsity", "n_domains")]), "sparsity", dp=9)


@entry("dataset_features")
def dataset_features(s, d):
    """All of them, with those that need a decomposition or draws; in the tests against a loop."""
    p = A.points(s, d)
    out = X.dataset_features(A.expr(s, d), A.var(s, d), p, A.counts(s, d), p.select("i", "label"))
    return rounded(out, *out.columns)


@entry("synthetic_tissue_qc")
def synthetic_tissue_qc(s, d):
    """Generators draw by hash; the tissue does not depend on partitions."""
    t = synthetic.make_tissue(s, 600, 50)
    return rounded(qc.basic_qc(t["expr"], t["var"]), "mito_pct")


@entry("synthetic_mixture")
def synthetic_mixture(s, d):
    return rounded(synthetic.make_mixture(s), "p")


@entry("bundle_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def bundle_roundtrip(s, d):
    base = shared_dir(s)
    path = f"{base}/tesselar/bundle-{uuid.uuid4().hex}"
    bundle.write_bundle({"nation": A.table(s, d, "nation")}, path)
    return bundle.read_bundle(s, path)["nation"].select("n_nationkey", "n_name", "n_regionkey")


@entry("knowledge_base_roundtrip", with_("perf") + "SELECT dataset, config, round(avg(score), 9) AS score FROM perf GROUP BY 1, 2")
def knowledge_base_roundtrip(s, d):
    base = shared_dir(s)
    path = f"{base}/tesselar/kb-{uuid.uuid4().hex}"
    means = A.perf(s, d).groupBy("dataset", "config").agg(F.round(F.avg("score"), 9).alias("score"))
    longtable.write_knowledge_base(means, path)
    return longtable.read_knowledge_base_lines(s, path)
