"""Queries that compare all seeds, batches, parts and configurations of their tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import graph, integrate, labels
from ..sources import longtable
from . import adapters as A
from .adapters import knn_sql, with_
from .tables import shared_dir
from .queries_evidence import MEANS, means
from .queries_matrix import EVID, MK, _step, batches, markers, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@entry("resolve_markers", with_("var") + ", m AS (SELECT p_brand AS label, p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS alias FROM part), ex AS (SELECT feature_name AS alias, min(gene_id) AS g FROM var GROUP BY 1), fo AS (SELECT lower(feature_name) AS low, min(gene_id) AS g2 FROM var GROUP BY 1 HAVING count(*) = 1) SELECT label, seq, m.alias, coalesce(g, g2) AS gene_id FROM m LEFT JOIN ex ON m.alias = ex.alias LEFT JOIN fo ON lower(m.alias) = fo.low")
def resolve_markers(s, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    m = A.table(s, d, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("seq"), name.alias("alias"))
    return labels.resolve_markers(m, A.var(s, d)).select("label", "seq", "alias", "gene_id")


@entry("long_csv_landscape", with_("perf") + "SELECT dataset, config, round(avg(score), 6) AS score, count(*) AS n FROM perf WHERE status <> 'R' GROUP BY 1, 2")
def long_csv_landscape(s, d):
    """The long table of all seeds through a CSV folder and back, rows that failed left out."""
    import uuid

    base = shared_dir(s)
    path = f"{base}/tesselar/csv-{uuid.uuid4().hex}"
    A.perf(s, d).withColumn("status", F.when(F.col("status") == "R", "timeout").otherwise("ok")).write.option("header", True).csv(path)
    out = longtable.read_long_csv(s, path).groupBy("dataset", "config").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    return rounded(out, "score")


@entry("mutual_nearest_anchors", with_("pts", "ab AS (SELECT a.i, b.i AS j, CAST(a.i % 3 AS INTEGER) AS a, CAST(b.i % 3 AS INTEGER) AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM pts a JOIN pts b ON a.i % 3 < b.i % 3)", "f AS (SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY i, b ORDER BY d2, j) = 1)", "g AS (SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY j, a ORDER BY d2, i) = 1)") + "SELECT f.a, f.b, f.i, f.j, round(f.d2, 9) AS d2 FROM f JOIN g ON f.i = g.i AND f.j = g.j")
def mutual_nearest_anchors(s, d):
    """Anchors of every pair of batches."""
    found = None
    for a, b in ((0, 1), (0, 2), (1, 2)):
        one = integrate.mutual_anchors(A.points(s, d), batches(s, d), a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "i", "j", "d2")
        found = one if found is None else found.unionByName(one)
    return rounded(found, "d2", dp=9)


@entry("sign_flip_permutation", with_("perf", MEANS, "df AS (SELECT a.config AS a, b.config AS b, a.dataset, round(a.score - b.score, 9) AS d FROM means a JOIN means b ON a.dataset = b.dataset AND a.config < b.config)", "fl AS (SELECT a, b, f, abs(avg(CASE WHEN left(md5(f || ':' || dataset), 1) < '8' THEN d ELSE -d END)) AS m, abs(avg(d)) AS o FROM df, (SELECT unnest(range(1, 65)) AS f) GROUP BY 1, 2, 3)") + "SELECT a, b, round((sum(CASE WHEN m >= o - 1e-12 THEN 1 ELSE 0 END) + 1.0) / 65, 6) AS p FROM fl GROUP BY 1, 2")
def sign_flip_permutation(s, d):
    m = means(s, d)
    one = m.select("dataset", F.col("config").alias("a"), F.col("score").alias("sa"))
    two = m.select("dataset", F.col("config").alias("b"), F.col("score").alias("sb"))
    pairs = one.join(two, "dataset").filter("a < b")
    return rounded(E.sign_flip_p(pairs.select("a", "b", "dataset", F.round(F.col("sa") - F.col("sb"), 9).alias("d"))), "p")


ROUNDS = 100


@entry("spatial_simplex_deconv", with_("pts", "val", "cnt", MK, knn_sql(6), EVID.replace(" AS (", " AS MATERIALIZED ("), *[_step(f"p{k}" if k else "ev", f"p{k + 1}").replace(" AS (SELECT i, label, least", " AS MATERIALIZED (SELECT i, label, least") for k in range(ROUNDS)]) + f"SELECT i, label, round(p, 6) AS p FROM p{ROUNDS}")
def spatial_simplex_deconv(s, d):
    """The reference's 100 rounds; in the tests against a loop."""
    e = labels.marker_evidence(A.counts(s, d), markers(s))
    return rounded(labels.simplex_deconv(e, graph.knn(A.points(s, d), 6)), "p")
