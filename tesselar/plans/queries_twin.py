"""Registered queries of the digital twin, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import twin as T
from . import adapters as A
from . import landscape as L
from .adapters import knn_sql, with_
from .queries_matrix import rounded
from .tables import saved, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEED = 7


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _uniform(which: str) -> str:
    return f"((CAST('0x' || left(md5('{SEED}:{which}:' || i || ':' || gene), 8) AS UBIGINT) + 0.5) / 4294967296.0)"


def _mixed(kind: str, t: float) -> str:
    a, b = math.sqrt(1 - t), math.sqrt(t)
    return f"({a * a!r} * {kind}uu + {2 * a * b!r} * {kind}us + {b * b!r} * {kind}ss)"


def _scaled(source: str, columns: dict[str, str], keep: str) -> str:
    w = "OVER (PARTITION BY label, gene)"
    return f"SELECT {keep}, " + ", ".join(f"CASE WHEN round(stddev_pop({x}) {w}, 12) > 0 THEN ({x} - avg({x}) {w}) / stddev_pop({x}) {w} ELSE 0 END AS {c}" for c, x in columns.items()) + f" FROM {source}"


def _features(name: str, source: str) -> str:
    return f"""{name} AS (SELECT m.gene, mean, sd, coalesce(n * e / (w * p), 0) AS autocorrelation FROM (SELECT gene, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n, var_pop(v) * count(*) AS p FROM {source} GROUP BY 1) m
  JOIN (SELECT x.gene, count(*) AS w, sum((x.v - mx) * (y.v - mx)) AS e FROM sy JOIN (SELECT *, avg(v) OVER (PARTITION BY gene) AS mx FROM {source}) x ON x.i = sy.i JOIN {source} y ON y.i = sy.j AND y.gene = x.gene GROUP BY 1) e ON e.gene = m.gene)"""


TWIN = (
    "pts", "val", knn_sql(6), "sy AS MATERIALIZED (SELECT i, j FROM knn UNION SELECT j, i FROM knn)",
    f"no AS MATERIALIZED (SELECT i, gene, label, v, sqrt(-2 * ln({_uniform('a')})) * cos(2 * pi() * {_uniform('b')}) AS u FROM (SELECT val.i, gene, label, v FROM val JOIN pts USING (i)))",
    "sm AS (SELECT n.i, gene, avg(u) AS s FROM (SELECT i, j FROM sy UNION ALL SELECT i, i FROM pts) n JOIN no ON no.i = n.j GROUP BY 1, 2)",
    "fi AS MATERIALIZED (" + _scaled("no JOIN sm USING (i, gene)", {"r": "v", "u": "u", "s": "s"}, "i, gene, label, v") + ")",
    "ed AS (SELECT x.gene, count(*) AS w, sum(x.r * y.r) AS err, sum(x.u * y.u) AS euu, sum(x.u * y.s) AS eus, sum(x.s * y.s) AS ess FROM sy JOIN fi x ON x.i = sy.i JOIN fi y ON y.i = sy.j AND y.gene = x.gene GROUP BY 1)",
    "po AS (SELECT gene, count(*) AS n, sum(r * r) AS prr, sum(u * u) AS puu, sum(u * s) AS pus, sum(s * s) AS pss FROM fi GROUP BY 1)",
    "sh AS (SELECT gene, list_min([" + ", ".join(f"{{'gap': round(abs(coalesce(n * {_mixed('e', t)} / (w * {_mixed('p', t)}), 0) - coalesce(n * err / (w * prr), 0)), 9), 'share': {t!r}::DOUBLE}}" for t in T.TRIALS) + "]).share AS share FROM ed JOIN po USING (gene))",
    "mi AS (SELECT i, gene, label, v, sqrt(1 - share) * u + sqrt(share) * s AS f FROM fi JOIN sh USING (gene))", "st AS (" + _scaled("mi", {"f": "f"}, "i, gene, label, v") + ")",
    "tw AS MATERIALIZED (SELECT i, gene, avg(v) OVER w + stddev_pop(v) OVER w * f AS v FROM st WINDOW w AS (PARTITION BY label, gene))",
)


def _twin(s, d):
    p = A.points(s, d)
    edges = graph.knn(p, 6)
    return saved(T.make_twin(A.values(s, d), p.select("i", "label"), edges, SEED), "twin"), edges


@entry("digital_twin", with_(*TWIN) + "SELECT i, CAST(gene AS INTEGER) AS gene, round(v, 6) AS v FROM tw")
def digital_twin(s, d):
    """The twin of all vectors, with their labels as its domains."""
    return rounded(_twin(s, d)[0], "v")


@entry("digital_twin_match", with_(*TWIN, _features("fa", "val"), _features("fb", "tw"), "lo AS (SELECT gene, 'mean' AS f, fa.mean AS a, fb.mean AS b FROM fa JOIN fb USING (gene) UNION ALL SELECT gene, 'sd', fa.sd, fb.sd FROM fa JOIN fb USING (gene) UNION ALL SELECT gene, 'autocorrelation', fa.autocorrelation, fb.autocorrelation FROM fa JOIN fb USING (gene))")
  + """SELECT count(*) AS features, round(sqrt(avg(power((b - a) / greatest(abs(a), 1e-3), 2))), 5) AS match_l2, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS match_cosine, round(max(abs(b - a)) FILTER (WHERE f = 'mean'), 6) AS greatest_mean_gap, round(max(abs(b - a)) FILTER (WHERE f = 'sd'), 6) AS greatest_sd_gap,
  round(max(abs(b - a)) FILTER (WHERE f = 'autocorrelation'), 6) AS greatest_autocorrelation_gap FROM lo""")
def digital_twin_match(s, d):
    """How near the twin's genes come to the sample's."""
    new, edges = _twin(s, d)
    out = T.match_report(T.gene_features(A.values(s, d), edges), T.gene_features(new, edges))
    return rounded(rounded(out, "match_l2", dp=5), "match_cosine", "greatest_mean_gap", "greatest_sd_gap", "greatest_autocorrelation_gap")


@entry("digital_twin_ranking")
def digital_twin_ranking(s, d):
    """Two clusterings ranked on the twin, whose domains are known; depends on k-means starts."""
    new, edges = _twin(s, d)
    p = A.points(s, d)
    sample = {"twin": {"v": new, "points": p, "edges": edges, "truth": p.select("i", "label")}}
    scores = L.landscape(L.run_tasks(s, sample, {"domain_detection": ["kmeans", "bisecting_kmeans"]}, f"{shared_dir(s)}/tesselar/runs-{uuid.uuid4().hex}", {"twin": {"n_domains": 4}}))
    return rounded(scores.select("config", "score"), "score").orderBy(F.desc("score"), "config")
