"""Registered queries of the number of domains, with SQL that makes the same search: draws, centres, passes and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import kselect as K
from . import adapters as A
from .adapters import knn_sql, with_
from .queries_matrix import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KS = list(range(2, 9))
NEAR, WEIGHT = 5, 0.75


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _uniform(key: str) -> str:
    return f"((CAST('0x' || left(md5({key}), 8) AS UBIGINT) + 0.5) / 4294967296.0)"


def _search() -> list[str]:
    """Sets of points, their first centres and what the passes make of them."""
    parts = [
        knn_sql(NEAR),
        "em AS MATERIALIZED (SELECT vec_id AS i, CAST(embedding[3:64] AS DOUBLE[]) AS v FROM embeddings)",
        "cell AS MATERIALIZED (SELECT i, unnest(range(len(v))) AS g, unnest(v) AS x FROM em)",
        "box AS (SELECT g, min(x) AS lo, max(x) AS hi FROM cell GROUP BY 1)",
        f"""pt AS MATERIALIZED (SELECT 'expression' AS st, i, v FROM em UNION ALL
  SELECT 'reference' || r, i, list(lo + (hi - lo) * {_uniform("r || ':' || i || ':' || g")} ORDER BY g) FROM (SELECT i FROM em), box, (SELECT unnest(range(1, {K.REFERENCES + 1})) AS r) GROUP BY 1, 2 UNION ALL
  SELECT 'smooth', i, list({1 - WEIGHT} * x + {WEIGHT} * m ORDER BY g) FROM cell JOIN (SELECT n.i, g, avg(x) AS m FROM (SELECT i, j FROM knn UNION ALL SELECT i, i FROM em) n JOIN cell ON cell.i = n.j GROUP BY 1, 2) USING (i, g) GROUP BY 1, 2)""",
    ]
    for c in range(max(KS)):
        u = _uniform(f"'seed:{c}:' || i")
        source = "(SELECT *, 1.0 AS d FROM pt)" if c == 0 else f"m{c - 1}"
        parts.append(f"s{c} AS MATERIALIZED (SELECT st, arg_min(v, (-ln({u}) / d, i)) AS v FROM {source} WHERE d > 0 GROUP BY 1)")
        far = "power(list_distance(p.v, s.v), 2)"
        parts.append(f"m{c} AS MATERIALIZED (SELECT p.st, p.i, p.v, {far if c == 0 else f'least(p.d, {far})'} AS d FROM {'pt' if c == 0 else f'm{c - 1}'} p JOIN s{c} s USING (st))")
    seeds = " UNION ALL ".join(f"SELECT st, {c} AS c, v FROM s{c}" for c in range(max(KS)))
    parts.append(f"ce0 AS MATERIALIZED (SELECT st, k, c, v FROM ({seeds}), (SELECT unnest({KS}) AS k) WHERE c < k)")
    for t in range(K.ROUNDS + 1):
        parts.append(f"la{t} AS MATERIALIZED (SELECT p.st, k, p.i, arg_min(c, (list_distance(p.v, e.v), c)) AS c, any_value(p.v) AS v FROM pt p JOIN ce{t} e USING (st) GROUP BY 1, 2, 3)")
        parts.append(f"mn{t} AS MATERIALIZED (SELECT st, k, c, list(x ORDER BY g) AS v, list(w ORDER BY g) AS w, any_value(n) AS n FROM (SELECT st, k, c, g, avg(x) AS x, var_pop(x) AS w, count(*) AS n FROM (SELECT st, k, c, unnest(range(len(v))) AS g, unnest(v) AS x FROM la{t}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)")
        if t < K.ROUNDS:
            parts.append(f"ce{t + 1} AS MATERIALIZED (SELECT st, k, c, coalesce(mn{t}.v, ce{t}.v) AS v FROM ce{t} LEFT JOIN mn{t} USING (st, k, c))")
    last = K.ROUNDS
    parts += [
        f"la AS (SELECT * FROM la{last})",
        f"mn AS (SELECT m.*, s.s FROM mn{last} m JOIN (SELECT l.st, l.k, l.c, avg(list_distance(l.v, m.v)) AS s FROM la{last} l JOIN mn{last} m USING (st, k, c) GROUP BY 1, 2, 3) s USING (st, k, c))",
        "tt AS (SELECT st, k, sum(n) AS n, count(*) AS have, sum(n * list_sum(w)) AS within FROM mn GROUP BY 1, 2)",
        "gm AS (SELECT st, list(x ORDER BY g) AS m FROM (SELECT st, g, avg(x) AS x FROM (SELECT st, unnest(range(len(v))) AS g, unnest(v) AS x FROM pt) GROUP BY 1, 2) GROUP BY 1)",
        "ch AS (SELECT st, k, (sum(mn.n * power(list_distance(v, m), 2)) / (any_value(have) - 1)) / (any_value(within) / (any_value(tt.n) - any_value(have))) AS s FROM mn JOIN gm USING (st) JOIN tt USING (st, k) GROUP BY 1, 2)",
        "db AS (SELECT st, k, -avg(r) AS s FROM (SELECT a.st, a.k, a.c, max((a.s + b.s) / list_distance(a.v, b.v)) AS r FROM mn a JOIN mn b ON a.st = b.st AND a.k = b.k AND a.c <> b.c GROUP BY 1, 2, 3) GROUP BY 1, 2)",
        """bi AS (SELECT st, k, CASE WHEN any_value(have) = k AND min(mn.n) >= 2 THEN 2 * sum(mn.n * (-0.5 * (62 * ln(2 * pi()) + list_sum(list_transform(w, lambda x: ln(x + 1e-6)))) - 0.5 * list_sum(list_transform(w, lambda x: x / (x + 1e-6))) + ln(mn.n / tt.n::DOUBLE))) - (2 * k * 62 + k - 1) * ln(any_value(tt.n))
  ELSE -(1e6 + 1e3 * k) END AS s FROM mn JOIN tt USING (st, k) GROUP BY 1, 2)""",
        f"ga AS (SELECT k, avg(lw) FILTER (WHERE st <> 'expression') - max(lw) FILTER (WHERE st = 'expression') AS s, stddev_samp(lw) FILTER (WHERE st <> 'expression') * sqrt(1 + 1 / {K.REFERENCES}.0) AS e FROM (SELECT st, k, ln(within + 1e-12) AS lw FROM tt WHERE st <> 'smooth') GROUP BY 1)",
        """si AS (SELECT st, k, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM (SELECT st, k, i, max(CASE WHEN c = own THEN d END) AS a, min(CASE WHEN c <> own THEN d END) AS b FROM
  (SELECT x.st, y.k, x.i, y.c, z.c AS own, avg(x.d) AS d FROM (SELECT p.st, p.i, q.i AS j, list_distance(p.v, q.v) AS d FROM pt p JOIN pt q ON p.st = q.st AND p.i <> q.i WHERE p.st IN ('expression', 'smooth')) x JOIN la y ON y.st = x.st AND y.i = x.j JOIN la z ON z.st = x.st AND z.i = x.i AND z.k = y.k GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
        """co AS (SELECT k, (po - pe) / (1 - pe) AS s FROM (SELECT a.k, avg(CASE WHEN a.c = b.c THEN 1.0 ELSE 0.0 END) AS po FROM knn JOIN la a ON a.i = knn.i AND a.st = 'smooth' JOIN la b ON b.i = knn.j AND b.st = 'smooth' AND b.k = a.k GROUP BY 1)
  JOIN (SELECT k, sum(power(n / (SELECT count(*) FROM em)::DOUBLE, 2)) AS pe FROM mn WHERE st = 'smooth' GROUP BY 1) USING (k))""",
        """cv AS MATERIALIZED (SELECT 'calinski_harabasz' AS estimator, k, s AS score FROM ch WHERE st = 'expression' UNION ALL SELECT 'davies_bouldin', k, s FROM db WHERE st = 'expression' UNION ALL SELECT 'bic_gmm', k, s FROM bi WHERE st = 'expression' UNION ALL SELECT 'gap', k, s FROM ga
  UNION ALL SELECT 'silhouette', k, s FROM si WHERE st = 'expression' UNION ALL SELECT 'spatial_silhouette', k, s FROM si WHERE st = 'smooth' UNION ALL SELECT 'spatial_coherence', k, s FROM co)""",
        "we AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in K.WITH_PLACES) + "]) AS estimator, unnest([" + ", ".join(str(K.WEIGHTS[m]) for m in K.WITH_PLACES) + "])::DOUBLE AS w)",
        "en AS (SELECT k, sum(w * CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (score - lo) / (hi - lo) END) / (SELECT sum(w) FROM we) AS s FROM cv JOIN we USING (estimator) JOIN (SELECT estimator, min(score) AS lo, max(score) AS hi FROM cv GROUP BY 1) USING (estimator) GROUP BY 1)",
    ]
    return parts


CURVES = with_("pts", *_search())
BEST = """SELECT estimator, CAST(arg_min(k, (-round(score, 9), k)) AS INTEGER) AS k FROM cv WHERE estimator <> 'gap' GROUP BY 1
UNION ALL SELECT 'gap', CAST(coalesce(min(k) FILTER (WHERE round(s - s2 + e2, 9) >= 0), max(k)) AS INTEGER) FROM (SELECT k, s, lead(s) OVER (ORDER BY k) AS s2, lead(e) OVER (ORDER BY k) AS e2 FROM ga)
UNION ALL SELECT 'ensemble', CAST(arg_min(k, (-round(co, 9), r)) AS INTEGER) FROM (SELECT en.k, co.s AS co, row_number() OVER (ORDER BY round(en.s, 9) DESC, en.k) AS r FROM en JOIN co USING (k)) WHERE r <= 3"""


def _estimated(s, d):
    vecs = A.table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.slice("embedding", 3, 62).cast("array<double>").alias("vec"))
    return vecs, graph.knn(A.points(s, d), NEAR)


@entry("k_curves", CURVES + "SELECT estimator, CAST(k AS INTEGER) AS k, round(score, 6) AS score FROM (SELECT * FROM cv UNION ALL SELECT 'ensemble', k, s FROM en)")
def k_curves(s, d):
    """Seven estimators and the ensemble for each k; the embedding is the values themselves, whose distances are those of all
    their components."""
    return rounded(K.estimate_k(*_estimated(s, d), 2, max(KS), WEIGHT)[0], "score")


@entry("k_estimates", CURVES + BEST)
def k_estimates(s, d):
    return K.estimate_k(*_estimated(s, d), 2, max(KS), WEIGHT)[1]


@entry("k_dual_track", CURVES + f"SELECT estimator, k AS estimated_k, (SELECT CAST(count(DISTINCT label) AS INTEGER) FROM pts) AS oracle_k, k = (SELECT count(DISTINCT label) FROM pts) AS k_match FROM ({BEST}) WHERE estimator = 'ensemble'")
def k_dual_track(s, d):
    return K.dual_track(*_estimated(s, d), A.points(s, d).select("i", "label"), k_max=max(KS), weight=WEIGHT)
