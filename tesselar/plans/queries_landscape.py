"""Registered queries of runs of methods over data sets, stopped and resumed, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from . import adapters as A
from . import landscape as L
from .adapters import knn_sql, with_
from .queries_matrix import rounded
from .tables import saved, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GENES = ("spatial_variance_ratio", "gearys_c", "not_a_method")


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _samples(s: SparkSession, d: str) -> dict[str, dict[str, DataFrame]]:
    """Three samples, dealt by number, with the genes 3 to 12 as what is to be found."""
    out = {}
    for b in range(3):
        mine = lambda df, b=b: saved(df.filter(F.col("i") % 3 == b), f"sample_{b}")
        points = mine(A.points(s, d))
        out[f"sample_{b}"] = {"v": mine(A.values(s, d)), "points": points, "edges": saved(graph.knn(points, 6), "edges"), "truth": points.select("i", "label"), "true_markers": s.range(3, 13).select(F.col("id").cast("int").alias("gene"))}
    return out


BATCHES = (
    "pts",
    "val",
    "bp AS (SELECT i, x, y, i % 3 AS b FROM pts)",
    knn_sql(6, src="bp", part="b"),
    "pr AS MATERIALIZED (SELECT knn.i % 3 AS b, knn.i, x.gene, x.v, y.v AS vj FROM knn JOIN val x ON x.i = knn.i JOIN val y ON y.i = knn.j AND y.gene = x.gene)",
    """sg AS (SELECT b, 'spatial_variance_ratio' AS method, gene, round(var_pop(m) / var_pop(v), 9) AS s FROM (SELECT b, i, gene, avg(vj) AS m, any_value(v) AS v FROM pr GROUP BY 1, 2, 3) GROUP BY 1, 3 UNION ALL
  SELECT b, 'gearys_c', gene, round(1 - (n - 1) * num / (2.0 * w * ss), 9) FROM (SELECT b, gene, sum((v - vj) * (v - vj)) AS num, count(*) AS w FROM pr GROUP BY 1, 2) JOIN (SELECT i % 3 AS b, gene, count(*) AS n, var_pop(v) * count(*) AS ss FROM val GROUP BY 1, 2) USING (b, gene)),
tp AS (SELECT b, method, avg(CASE WHEN gene BETWEEN 3 AND 12 THEN 1.0 ELSE 0.0 END) AS score FROM (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY b, method ORDER BY s DESC, gene) <= 10) GROUP BY 1, 2)""",
)


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """The run is stopped after two jobs and taken up again."""
    path, samples = f"{shared_dir(s)}/tesselar/runs-{uuid.uuid4().hex}", _samples(s, d)
    L.run_tasks(s, samples, {"spatially_variable_genes": list(GENES)}, path, most=2)
    return L.run_tasks(s, samples, {"spatially_variable_genes": list(GENES)}, path)


@entry("landscape_runs", with_(*BATCHES) + """SELECT 'sample_' || b AS dataset, method, 'ok' AS status, round(score, 6) AS score FROM tp UNION ALL SELECT 'sample_' || unnest(range(3)), 'not_a_method', 'failed', NULL""")
def landscape_runs(s, d):
    """Two methods on three samples, and one that nobody knows."""
    return rounded(_resumed(s, d).select("dataset", "method", "status", "score"), "score")


@entry("landscape_winners", with_(*BATCHES, "wi AS (SELECT b, max(score) AS top FROM tp GROUP BY 1)") + "SELECT 'spatially_variable_genes' AS category, 'sample_' || b AS dataset, min(method) FILTER (WHERE score = top) AS config, round(max(score), 6) AS score, array_to_string(list(method ORDER BY method) FILTER (WHERE score >= 0.95 * top), ',') AS niches FROM tp JOIN wi USING (b) GROUP BY b")
def landscape_winners(s, d):
    return rounded(L.winners(L.landscape(_resumed(s, d))).withColumn("niches", F.array_join("niches", ",")), "score")


@entry("landscape_domains")
def landscape_domains(s, d):
    """Two clusterings of each sample against its labels; depends on k-means starts."""
    path = f"{shared_dir(s)}/tesselar/runs-{uuid.uuid4().hex}"
    return rounded(L.landscape(L.run_tasks(s, _samples(s, d), {"domain_detection": ["kmeans", "bisecting_kmeans"]}, path)).drop("secs"), "score")
