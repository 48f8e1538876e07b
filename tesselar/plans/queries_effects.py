"""Registered queries of effects with intervals and of ensembles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import effects as X
from ..operators import recommend as R
from . import adapters as A
from .adapters import with_
from .queries_matrix import rounded
from .queries_recommend import KNOWN, META, RANKED, known, near
from .queries_selection import DRAWS, _weight

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _levels(s: SparkSession, d: str) -> DataFrame:
    """The line number is the knob, data sets are replicates."""
    return A.perf(s, d).groupBy("config", F.col("seed").alias("level"), F.col("dataset").alias("replicate")).agg(F.avg("score").cast("double").alias("score"))


LEVELS = "lv AS MATERIALIZED (SELECT config, seed AS level, dataset AS rep, avg(score) AS score FROM perf GROUP BY 1, 2, 3), en AS (SELECT min(level) AS lo, max(level) AS hi FROM lv)"


@entry("causal_effects", with_("perf", LEVELS, "sd AS MATERIALIZED (SELECT config, CASE WHEN level = hi THEN 'hi' ELSE 'lo' END AS side, CASE WHEN level = hi THEN 'hi' ELSE 'lo' END || ':' || rep AS unit, score FROM lv, en WHERE level IN (lo, hi))",
  f"wt AS (SELECT * FROM (SELECT b, unit, {_weight('b', 'unit')} AS w FROM (SELECT DISTINCT unit FROM sd), (SELECT unnest(range(1, {DRAWS + 1})) AS b)) WHERE w > 0)",
  "dr AS (SELECT config, b, max(m) FILTER (WHERE side = 'hi') - max(m) FILTER (WHERE side = 'lo') AS e FROM (SELECT config, b, side, sum(w * score) / sum(w) AS m FROM sd JOIN wt USING (unit) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
  "qq AS (SELECT config, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi FROM dr GROUP BY 1)", "pt AS (SELECT config, avg(score) FILTER (WHERE side = 'lo') AS a, avg(score) FILTER (WHERE side = 'hi') AS b, count(*) FILTER (WHERE side = 'lo') AS na, count(*) FILTER (WHERE side = 'hi') AS nb FROM sd GROUP BY 1)")
  + """SELECT c.config, CASE WHEN na >= 2 AND nb >= 2 THEN round(b - a, 9) END AS effect, CASE WHEN na >= 2 AND nb >= 2 THEN round(qq.lo, 9) END AS ci_low, CASE WHEN na >= 2 AND nb >= 2 THEN round(qq.hi, 9) END AS ci_high, coalesce(na >= 2 AND nb >= 2 AND (round(qq.lo, 12) > 0 OR round(qq.hi, 12) < 0), FALSE) AS significant,
  round(a, 9) AS score_lo, round(b, 9) AS score_hi, coalesce(na, 0) AS support_lo, coalesce(nb, 0) AS support_hi FROM (SELECT DISTINCT config FROM lv) c LEFT JOIN pt USING (config) LEFT JOIN qq USING (config)""")
def causal_effects(s, d):
    return rounded(X.causal_effects(_levels(s, d), DRAWS), "effect", "ci_low", "ci_high", "score_lo", "score_hi", dp=9)


@entry("causal_grid", with_("perf", LEVELS) + "SELECT config, level, round(avg(score), 9) AS score, count(*) AS n FROM lv GROUP BY 1, 2")
def causal_grid(s, d):
    return rounded(X.grid_means(_levels(s, d)), "score", dp=9)


def _components(s: SparkSession, d: str) -> DataFrame:
    """Regions are donors, their nations components: what discounts and taxes differ by from their middle."""
    t = lambda n: A.table(s, d, n)
    li = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = li.groupBy(F.col("r_name").alias("donor"), F.col("n_name").alias("component"), F.col("n_nationkey").alias("k")).agg((F.round(F.avg("l_discount"), 9) - 0.049).alias("up"), (F.round(F.avg("l_tax"), 9) - 0.041).alias("down"), F.count("*").alias("n"))
    return X.admitted(c.withColumns({"expected_class": F.when(F.col("k") % 5 == 4, "other").otherwise("program"), "direction_ok": F.col("up") > -0.002}), "program")


COMPONENTS = "co AS MATERIALIZED (SELECT * FROM (SELECT r_name AS donor, n_name AS component, n_nationkey AS k, round(avg(l_discount), 9) - 0.049 AS up, round(avg(l_tax), 9) - 0.041 AS down, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3) WHERE k % 5 <> 4 AND up > -0.002)"
UNIT = "(donor || ':' || component)"
DONORS = "dn AS (SELECT donor, count(*) AS n_components, sum(n) AS n_spots, sum(n * up) / sum(n) AS up, sum(n * down) / sum(n) AS down, avg(CASE WHEN co.up > 0 AND co.down < 0 THEN 1.0 ELSE 0.0 END) AS direction_rate FROM co GROUP BY 1)"


@entry("donor_means", with_(COMPONENTS, DONORS) + "SELECT donor, n_components, CAST(n_spots AS BIGINT) AS n_spots, round(up, 9) AS up, round(down, 9) AS down, round(direction_rate, 6) AS direction_rate FROM dn")
def donor_means(s, d):
    return rounded(rounded(X.donor_means(_components(s, d)), "up", "down", dp=9), "direction_rate")


@entry("donor_bootstrap", with_(COMPONENTS, DONORS, f"wt AS (SELECT * FROM (SELECT b, donor, component, {_weight('b', UNIT)} AS w FROM co, (SELECT unnest(range(1, {DRAWS + 1})) AS b)) WHERE w > 0)",
  "pd AS (SELECT b, donor, sum(w * n * up) / sum(w * n) AS up, sum(w * n * down) / sum(w * n) AS down, sum(w * CASE WHEN co.up > 0 AND co.down < 0 THEN 1.0 ELSE 0.0 END) / sum(w) AS direction_rate FROM co JOIN wt USING (donor, component) GROUP BY 1, 2)",
  "lo AS (SELECT b, unnest(['up', 'down', 'direction_rate']) AS effect, unnest([avg(up), avg(down), avg(direction_rate)]) AS m FROM pd GROUP BY b)", "po AS (SELECT unnest(['up', 'down', 'direction_rate']) AS effect, unnest([avg(up), avg(down), avg(direction_rate)]) AS mean, count(*) AS donors FROM dn)")
  + "SELECT effect, round(any_value(mean), 9) AS mean, round(median(m), 9) AS median, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high, round(coalesce(stddev_samp(m), 0), 9) AS std, any_value(donors) AS donors FROM po JOIN lo USING (effect) GROUP BY 1")
def donor_bootstrap(s, d):
    return rounded(X.donor_bootstrap(_components(s, d), DRAWS), "mean", "median", "ci_low", "ci_high", "std", dp=9)


@entry("ensemble_strategies", with_("perf", META, KNOWN, RANKED, "e2 AS (SELECT q, max(config) FILTER (WHERE rank = 1) AS a, max(config) FILTER (WHERE rank = 2) AS b, round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 9) AS l FROM rk GROUP BY 1)")
  + "SELECT q, a AS first, b AS second, l AS lead, CASE WHEN b IS NULL THEN 'only' WHEN l > 0.1 THEN 'strong' WHEN l > 0.03 THEN 'preferred' ELSE 'consensus' END AS strategy FROM e2")
def ensemble_strategies(s, d):
    return X.ensemble_strategy(R.ranked_methods(near(s, d), known(s, d), "high"))
