"""Registered queries of places' information, its null and the gains foretold from it, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import information as I
from . import adapters as A
from .adapters import with_
from .queries_matrix import rounded
from .queries_relational import _psi
from .tables import saved

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DRAWS = 19


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rows(s: SparkSession, d: str) -> DataFrame:
    take = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    return A.table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("label"), take(1, 2).alias("places"), take(3, 3).alias("expression"))


VV = "vv AS (SELECT vec_id AS i, CAST(label AS BIGINT) AS label, " + ", ".join(f"CAST(embedding[{g}] AS DOUBLE) AS x{g}" for g in range(1, 6)) + " FROM embeddings)"


def _information(name: str, source: str, dims: range, k: int = 3) -> str:
    """Of every group g of ``source(g, i, label, x1...)``: the estimate over all its pairs."""
    far = "greatest(" + ", ".join(f"abs(a.x{g} - b.x{g})" for g in dims) + ")"
    return f"""{name}d AS MATERIALIZED (SELECT a.g, a.i, a.label AS la, b.label AS lb, {far} AS d FROM {source} a JOIN {source} b ON a.g = b.g AND a.i <> b.i),
{name}k AS (SELECT g, i, la, max(d) AS d, count(*) AS lk FROM (SELECT * FROM {name}d WHERE la = lb QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY d) <= {k}) GROUP BY 1, 2, 3),
{name}m AS (SELECT a.g, a.i, a.la, any_value(a.lk) AS lk, greatest(count(*) FILTER (WHERE b.d <= a.d), 1) AS m FROM {name}k a JOIN {name}d b ON a.g = b.g AND a.i = b.i GROUP BY 1, 2, 3),
{name}n AS (SELECT g, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY g) AS al FROM {source} GROUP BY 1, 2),
{name} AS (SELECT h.g, coalesce(greatest(sum({_psi('n.al')} - {_psi('n.n')} + {_psi('lk')} - {_psi('m')}) / any_value(n.al), 0), 0) AS mi FROM (SELECT DISTINCT g FROM {source}) h LEFT JOIN {name}m ON {name}m.g = h.g LEFT JOIN {name}n n ON n.g = {name}m.g AND la = n.label GROUP BY 1)"""


def _z(o: str, m: str, sd: str) -> str:
    return f"CASE WHEN {sd} < 1e-12 THEN CASE WHEN {o} > {m} + 1e-12 THEN 'inf'::DOUBLE WHEN {o} < {m} - 1e-12 THEN '-inf'::DOUBLE ELSE 0 END ELSE ({o} - {m}) / {sd} END"


@entry("places_permutation", with_(VV, f"""dr AS (SELECT g, i, label, x3, x4, x5, row_number() OVER (PARTITION BY g ORDER BY i) AS r FROM vv, (SELECT unnest(range(1, {DRAWS + 1})) AS g)),
ot AS (SELECT g, x1, x2, row_number() OVER (PARTITION BY g ORDER BY md5(g || ':' || i), i) AS r FROM vv, (SELECT unnest(range(1, {DRAWS + 1})) AS g)),
sh AS MATERIALIZED (SELECT 0 AS g, i, label, x1, x2, x3, x4, x5 FROM vv UNION ALL SELECT g, i, label, x1, x2, x3, x4, x5 FROM dr JOIN ot USING (g, r)), ex AS MATERIALIZED (SELECT 0 AS g, i, label, x3, x4, x5 FROM vv)""",
  _information("mb", "sh", range(1, 6)), _information("me", "ex", range(3, 6)), f"""cd AS (SELECT mb.g, me.mi AS ie, mb.mi AS ib, round(greatest(mb.mi - me.mi, 0), 12) AS c, CASE WHEN me.mi > 1e-9 THEN round(greatest(mb.mi - me.mi, 0), 12) / me.mi END AS r FROM mb, me),
st AS (SELECT count(*) FILTER (WHERE g > 0) AS n, avg(c) FILTER (WHERE g > 0) AS mc, stddev_samp(c) FILTER (WHERE g > 0) AS sc, avg(r) FILTER (WHERE g > 0) AS mr, stddev_samp(r) FILTER (WHERE g > 0) AS sr, (count(*) FILTER (WHERE g > 0 AND c >= (SELECT c FROM cd WHERE g = 0)) + 1.0) / (count(*) FILTER (WHERE g > 0) + 1) AS pc,
  (count(*) FILTER (WHERE g > 0 AND r >= (SELECT r FROM cd WHERE g = 0)) + 1.0) / (count(r) FILTER (WHERE g > 0) + 1) AS pr, quantile_cont(r, 0.95) FILTER (WHERE g > 0) AS t FROM cd)""") + f"""SELECT round(ie, 6) AS i_expression, round(ib, 6) AS i_both, round(c, 6) AS conditional, round(r, 5) AS ratio, n AS n_null, round(mc, 6) AS mean_conditional, round(sc, 6) AS sd_conditional, round(mr, 5) AS mean_ratio, round(sr, 5) AS sd_ratio, round(pc, 6) AS p_conditional,
  CASE WHEN r IS NOT NULL THEN round(pr, 6) END AS p_ratio, round({_z('c', 'mc', 'sc')}, 4) AS z_conditional, round({_z('r', 'mr', 'sr')}, 4) AS z_ratio, pc < 0.05 AS significant, round(t, 5) AS threshold_significant, round(mr + 3 * sr, 5) AS threshold_critical,
  CASE WHEN pc >= 0.05 THEN 'not_above_null' WHEN {_z('c', 'mc', 'sc')} >= 3 THEN 'spatial-critical' ELSE 'modest-spatial-signal' END AS band FROM cd, st WHERE g = 0""")
def places_permutation(s, d):
    """What two coordinates add to three components against shuffled coordinates, all draws in one search."""
    out = I.permutation_null(_rows(s, d), DRAWS)
    return rounded(rounded(rounded(out, "i_expression", "i_both", "conditional", "mean_conditional", "sd_conditional", "p_conditional", "p_ratio"), "ratio", "mean_ratio", "sd_ratio", "threshold_significant", "threshold_critical", dp=5), "z_conditional", "z_ratio", dp=4)


GAINS = """nm AS (SELECT dataset, 'method' || (CAST(substr(config, 7) AS INTEGER) - 1) // 5 || '@sw0.' || (CAST(substr(config, 7) AS INTEGER) - 1) % 5 AS config, score FROM perf),
gm AS (SELECT dataset, config, split_part(config, '@', 1) AS method, avg(score) AS s FROM nm GROUP BY 1, 2),
gn AS (SELECT dataset, avg(b - o) AS gain FROM (SELECT dataset, method, max(s) FILTER (WHERE config = method || '@sw0.0') AS o, max(s) FILTER (WHERE NOT ends_with(config, '@sw0.0')) AS b FROM gm GROUP BY 1, 2) WHERE o IS NOT NULL AND b IS NOT NULL GROUP BY 1)"""


def _gains(s: SparkSession, d: str) -> DataFrame:
    """Five brands each are one method under five spatial weights."""
    n = F.substring("config", 7, 2).cast("int") - 1
    name = F.concat(F.lit("method"), F.floor(n / 5), F.lit("@sw0."), n % 5)
    return I.spatial_gains(A.perf(s, d).select("dataset", name.alias("config"), F.col("score").cast("double").alias("score")))


@entry("spatial_gains", with_("perf", GAINS) + "SELECT dataset, round(gain, 9) AS gain FROM gn")
def spatial_gains(s, d):
    return rounded(_gains(s, d), "gain", dp=9)


SLICES = (
    VV,
    "sl AS MATERIALIZED (SELECT i % 25 AS g, * FROM vv)",
    _information("mb", "sl", range(1, 6)),
    _information("me", "sl", range(3, 6)),
    GAINS,
    """ra AS (SELECT n_name AS dataset, CASE WHEN me.mi > 1e-9 THEN greatest(mb.mi - me.mi, 0) / me.mi END AS ratio FROM mb JOIN me USING (g) JOIN nation ON n_nationkey = g),
pa AS (SELECT dataset, round(ratio, 9) AS x, round(gain, 9) AS y FROM ra JOIN gn USING (dataset) WHERE ratio IS NOT NULL AND gain IS NOT NULL),
rr AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pa),
rh AS (SELECT count(*) AS n, CASE WHEN count(*) >= 2 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(corr(rx, ry), 12) END AS rho, count(DISTINCT x) < 2 OR count(DISTINCT y) < 2 AS flat FROM rr),
th AS (SELECT *, n - 2 AS df, atan(abs(rho * sqrt((n - 2) / (1 - rho * rho))) / sqrt(n - 2)) AS a FROM rh),
sr AS (SELECT *, 1 + coalesce(list_sum(list_transform(range(1, CASE WHEN df % 2 = 1 THEN (df - 1) // 2 ELSE df // 2 END), lambda j: power(cos(a), 2 * j) * list_product(list_transform(range(1, j + 1), lambda q: CASE WHEN df % 2 = 1 THEN 2.0 * q / (2 * q + 1) ELSE (2.0 * q - 1) / (2 * q) END)))), 0) AS f FROM th),
pv AS (SELECT *, CASE WHEN rho IS NOT NULL AND n > 2 THEN CASE WHEN abs(rho) >= 1 THEN 0 ELSE greatest(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (a + CASE WHEN df > 1 THEN sin(a) * cos(a) * f ELSE 0 END) ELSE sin(a) * f END, 0) END END AS p FROM sr),
pr AS (SELECT n, rho, p, CASE WHEN rho IS NULL OR p IS NULL THEN 'undefined' WHEN n < 8 THEN 'underpowered' WHEN rho > 0 AND p < 0.05 THEN 'supported' ELSE 'failed' END AS status,
  CASE WHEN n < 2 THEN 'fewer_than_two_finite_pairs' WHEN flat THEN 'zero_variance_in_ratio_or_gain' ELSE array_to_string(list_filter([CASE WHEN n < 8 THEN 'sample_size_below_minimum' END, CASE WHEN p IS NULL THEN 'correlation_undefined' END, CASE WHEN p IS NOT NULL AND rho <= 0 THEN 'correlation_nonpositive' END, CASE WHEN p >= 0.05 THEN 'correlation_not_significant' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM pv),
li AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pa),
lo AS (SELECT q.dataset, q.y - CASE WHEN var_pop(w.x) * count(*) > 1e-12 THEN regr_intercept(w.y, w.x) + regr_slope(w.y, w.x) * q.x ELSE avg(w.y) END AS e FROM pa q JOIN pa w ON q.dataset <> w.dataset GROUP BY q.dataset, q.x, q.y),
er AS (SELECT sum(power(y - a - b * x, 2)) AS ss, var_pop(y) * count(*) AS sy FROM pa, li),
ca AS (SELECT n, b AS slope, a AS intercept, sqrt(ss / greatest(n - 2, 1)) AS residual_std, sqrt((SELECT avg(e * e) FROM lo)) AS loo_rmse, 1 - ss / sy AS r_squared, rho, p, status, CASE status WHEN 'supported' THEN 'moderate' WHEN 'underpowered' THEN 'low' WHEN 'failed' THEN 'unsupported' ELSE 'undefined' END AS reliability FROM li, er, (SELECT rho, p, status FROM pr))""",
)


def _slices(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ratios of 25 slices, which are the points by number, named as the data sets; and with the data sets' gains."""
    r = I.ratios(_rows(s, d).withColumn("g", F.col("i") % 25))
    names = A.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("g"), F.col("n_name").alias("dataset"))
    found = saved(r.join(F.broadcast(names), "g").select("dataset", "ratio"), "slice_ratios")  # 25 nations
    return found, saved(found.join(_gains(s, d), "dataset"), "slice_records")


@entry("gain_predictor", with_("perf", *SLICES) + "SELECT n AS n_slices, round(rho, 6) AS rho, round(p, 6) AS p, status, reasons FROM pr")
def gain_predictor(s, d):
    return rounded(I.predictor(_slices(s, d)[1]), "rho", "p")


@entry("gain_calibration", with_("perf", *SLICES) + "SELECT n AS n_slices, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(residual_std, 6) AS residual_std, round(loo_rmse, 6) AS loo_rmse, round(r_squared, 6) AS r_squared, round(rho, 6) AS rho, round(p, 6) AS p, status, reliability FROM ca")
def gain_calibration(s, d):
    return rounded(I.gain_calibration(_slices(s, d)[1]), "slope", "intercept", "residual_std", "loo_rmse", "r_squared", "rho", "p")


@entry("expected_gains", with_("perf", *SLICES) + "SELECT dataset, round(ratio, 5) AS ratio, round(intercept + slope * round(ratio, 9), 6) AS expected, round(intercept + slope * round(ratio, 9) - 1.96 * loo_rmse, 6) AS low, round(intercept + slope * round(ratio, 9) + 1.96 * loo_rmse, 6) AS high, CASE WHEN ratio IS NOT NULL THEN reliability ELSE 'undefined' END AS reliability FROM ra, ca")
def expected_gains(s, d):
    r, records = _slices(s, d)
    return rounded(rounded(I.expected_gains(r, I.gain_calibration(records)), "expected", "low", "high"), "ratio", dp=5)
