"""Registered queries over benchmark evidence, streams and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import labels
from ..sources import longtable
from . import adapters as A
from .adapters import with_
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


#: The driver's tables hold whole numbers of hundredths, so means are compared at 9 places.
MEANS = "means AS (SELECT dataset, config, avg(score) AS score, avg(secs) AS secs, count(*) AS n FROM perf GROUP BY 1, 2)"


def means(s, d):
    return E.mean_scores(A.perf(s, d))


@entry("usable_runs", with_("perf") + "SELECT dataset, config, seed, score, secs, status FROM perf WHERE lower(trim(status)) NOT IN ('r') AND score IS NOT NULL")
def usable_runs(s, d):
    return E.usable(A.perf(s, d), ("r",))


@entry("landscape_means", with_("perf", MEANS) + "SELECT dataset, config, round(score, 6) AS score, round(secs, 6) AS secs, n FROM means")
def landscape_means(s, d):
    return rounded(means(s, d), "score", "secs")


@entry("mean_std_count", with_("perf") + "SELECT dataset, config, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, count(*) AS n FROM perf GROUP BY 1, 2")
def mean_std_count(s, d):
    return rounded(E.mean_std(A.perf(s, d)), "mean", "std")


PIVOTED = ("Brand#1", "Brand#2", "Brand#3", "Brand#11", "Brand#12")


@entry("pivot_mean", with_("perf") + "SELECT dataset, " + ", ".join(f"round(avg(score) FILTER (WHERE config = '{c}'), 6) AS \"{c.replace('#', '')}\"" for c in PIVOTED) + " FROM perf GROUP BY 1")
def pivot_mean(s, d):
    p = A.perf(s, d).groupBy("dataset").pivot("config", list(PIVOTED)).agg(F.avg("score"))
    return p.select("dataset", *[(F.round(f"`{c}`", 6) + 0.0).alias(c.replace("#", "")) for c in PIVOTED])


@entry("global_best", with_("perf", MEANS) + "SELECT config, round(avg(score), 6) AS mean, count(*) AS datasets FROM means GROUP BY 1 ORDER BY round(avg(score), 9) DESC, config LIMIT 1")
def global_best(s, d):
    return rounded(E.global_best(means(s, d)), "mean")


@entry("niches", with_("perf", MEANS) + "SELECT dataset, config, round(score, 6) AS score, round(best, 6) AS best FROM (SELECT *, max(score) OVER (PARTITION BY dataset) AS best FROM means) WHERE score >= 0.95 * best")
def niches(s, d):
    return rounded(E.niches(means(s, d)), "score", "best")


LOO = """tr AS (SELECT *, (sum(score) OVER c - score) / (count(*) OVER c - 1) AS train FROM means WINDOW c AS (PARTITION BY config)),
loo AS (SELECT dataset, config, score, oracle, oracle - score AS regret FROM (SELECT *, max(score) OVER (PARTITION BY dataset) AS oracle, row_number() OVER (PARTITION BY dataset ORDER BY round(train, 9) DESC, config) AS rk FROM tr WHERE isfinite(train)) WHERE rk = 1)"""


@entry("leave_one_out_regret", with_("perf", MEANS, LOO) + "SELECT dataset, config, round(score, 6) AS score, round(oracle, 6) AS oracle, round(regret, 6) AS regret FROM loo")
def leave_one_out_regret(s, d):
    return rounded(E.leave_one_out(means(s, d)), "score", "oracle", "regret")


@entry("average_ranks", with_("perf", MEANS, "m AS (SELECT dataset, config, round(score, 9) AS score FROM means)") + "SELECT dataset, config, round(score, 6) AS score, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS rank FROM m")
def average_ranks(s, d):
    m = means(s, d).select("dataset", "config", F.round("score", 9).alias("score"))
    return rounded(E.average_rank(m, "score", "dataset"), "score")


@entry("competition_ranks", with_("perf", MEANS, "m AS (SELECT config, round(avg(score), 9) AS score, left(config, 7) AS family FROM means GROUP BY config)") + "SELECT config, round(score, 6) AS score, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS overall, CAST(rank() OVER (PARTITION BY family ORDER BY score DESC) AS INTEGER) AS in_family FROM m")
def competition_ranks(s, d):
    from pyspark.sql import Window

    m = means(s, d).groupBy("config").agg(F.round(F.avg("score"), 9).alias("score")).withColumn("family", F.substring("config", 1, 7))
    out = m.withColumn("overall", F.rank().over(Window.orderBy(F.desc("score")))).withColumn("in_family", F.rank().over(Window.partitionBy("family").orderBy(F.desc("score"))))
    return rounded(out.drop("family"), "score")


@entry("kendalls_w", with_("perf", MEANS, "r AS (SELECT config, rank() OVER (PARTITION BY dataset ORDER BY round(score, 9) DESC) + (count(*) OVER (PARTITION BY dataset, round(score, 9)) - 1) / 2.0 AS rk FROM means)", "t AS (SELECT config, sum(rk) AS s, count(*) AS m FROM r GROUP BY 1)") + "SELECT round(12.0 * var_pop(s) * count(*) / (max(m) * max(m) * (power(count(*), 3) - count(*))), 6) AS w FROM t")
def kendalls_w(s, d):
    m = means(s, d).select("dataset", "config", F.round("score", 9).alias("score"))
    return rounded(E.kendalls_w(E.average_rank(m, "score", "dataset")), "w")


PT = "pt AS (SELECT row_number() OVER (ORDER BY user_id, event_type) AS k, count(*) AS c, avg(value) AS a FROM events GROUP BY user_id, event_type)"
PV = "pv AS (SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS test, least(1.0, round(abs(avg(value) - 50) / 50 + 0.001, 9)) AS p FROM events GROUP BY user_id, event_type)"


def pvalues(s, d):
    g = A.table(s, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("a"))
    return g.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("test"), F.least(F.lit(1.0), F.round(F.abs(F.col("a") - 50) / 50 + 0.001, 9)).alias("p"))


def _fdr(how: str, formula: str, frame: str) -> None:
    sql = with_(PV, "r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM pv)", "h AS (SELECT sum(1.0 / i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM pv))) AS i))")
    over = f" OVER (ORDER BY p, test {frame})" if frame else ""
    entry(f"fdr_{how}", sql + f"SELECT test, round(p, 6) AS p, round(least(greatest({formula}{over}, 0), 1), 6) AS q FROM r, h")(lambda s, d: rounded(E.step_up(pvalues(s, d), "p", "q", "test", how), "p", "q"))


_UP, _DOWN = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_fdr("bh", "min(p * m / r)", _UP)
_fdr("by", "min(p * m * h / r)", _UP)
_fdr("holm", "max(p * (m - r + 1))", _DOWN)
_fdr("bonferroni", "(p * m)", "")

OBJ = "obj AS (SELECT config, round(avg(score), 9) AS accuracy, round(avg(secs), 9) AS speed, round(stddev_pop(score), 9) AS spread FROM perf GROUP BY 1)"
DIRECTIONS = {"accuracy": "max", "speed": "min", "spread": "min"}


def objectives(s, d, *keys):
    return A.perf(s, d).groupBy(*keys, "config").agg(F.round(F.avg("score"), 9).alias("accuracy"), F.round(F.avg("secs"), 9).alias("speed"), F.round(F.stddev_pop("score"), 9).alias("spread"))


FRONT = """sp AS (SELECT (max(accuracy) - min(accuracy)) * 1e-3 AS ea, (max(speed) - min(speed)) * 1e-3 AS es, (max(spread) - min(spread)) * 1e-3 AS ep FROM obj),
front AS (SELECT * FROM obj l WHERE NOT EXISTS (SELECT 1 FROM obj r, sp WHERE r.config <> l.config AND NOT (r.accuracy < l.accuracy - ea OR r.speed > l.speed + es OR r.spread > l.spread + ep) AND (r.accuracy > l.accuracy + ea OR r.speed < l.speed - es OR r.spread < l.spread - ep)))"""


@entry("pareto_frontier", with_("perf", OBJ, FRONT) + "SELECT config, accuracy, speed, spread FROM front")
def pareto_frontier(s, d):
    return E.pareto_frontier(objectives(s, d), DIRECTIONS)


@entry("pareto_by_dataset", with_("perf", "o AS (SELECT dataset, config, round(avg(score), 9) AS accuracy, round(avg(secs), 9) AS speed FROM perf GROUP BY 1, 2)", "e AS (SELECT *, (max(accuracy) OVER w - min(accuracy) OVER w) * 1e-3 AS ea, (max(speed) OVER w - min(speed) OVER w) * 1e-3 AS es FROM o WINDOW w AS (PARTITION BY dataset))") + """
SELECT dataset, config, accuracy, speed FROM e l WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.dataset = l.dataset AND r.config <> l.config AND NOT (r.accuracy < l.accuracy - l.ea OR r.speed > l.speed + l.es) AND (r.accuracy > l.accuracy + l.ea OR r.speed < l.speed - l.es))""")
def pareto_by_dataset(s, d):
    return E.pareto_frontier(objectives(s, d, "dataset").drop("spread"), {"accuracy": "max", "speed": "min"}, by="dataset")


def _peeled(most: int) -> list[str]:
    """The fronts of what is left, one after another; no more than there are configurations."""
    parts = ["r0 AS (SELECT * FROM obj)"]
    for k in range(most):
        parts.append(FRONT.replace("sp AS", f"s{k} AS").replace("front AS", f"f{k} AS MATERIALIZED").replace("FROM obj", f"FROM r{k}").replace(", sp WHERE", f", s{k} WHERE"))
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} WHERE config NOT IN (SELECT config FROM f{k}))")
    return parts


@entry("pareto_layers", with_("perf", OBJ.replace("AS (", "AS MATERIALIZED (", 1), *_peeled(25)) + " UNION ALL ".join(f"SELECT config, {k} AS layer FROM f{k}" for k in range(25)))
def pareto_layers(s, d):
    """Peeled one after another."""
    return E.nondominated_layers(objectives(s, d), DIRECTIONS)


@entry("knee_point", with_("perf", OBJ, FRONT, "x AS (SELECT config, accuracy, speed, spread, CASE WHEN max(accuracy) OVER () > min(accuracy) OVER () THEN 1 - (accuracy - min(accuracy) OVER ()) / (max(accuracy) OVER () - min(accuracy) OVER ()) ELSE 0.5 END AS a, CASE WHEN max(speed) OVER () > min(speed) OVER () THEN (speed - min(speed) OVER ()) / (max(speed) OVER () - min(speed) OVER ()) ELSE 0.5 END AS b, CASE WHEN max(spread) OVER () > min(spread) OVER () THEN (spread - min(spread) OVER ()) / (max(spread) OVER () - min(spread) OVER ()) ELSE 0.5 END AS c FROM front)") + "SELECT config, accuracy, speed, spread, round(sqrt((a*a + b*b + c*c) / 3), 6) AS distance FROM x ORDER BY round(sqrt((a*a + b*b + c*c) / 3), 9), config LIMIT 1")
def knee_point(s, d):
    return rounded(E.knee_point(E.pareto_frontier(objectives(s, d), DIRECTIONS), DIRECTIONS), "distance")


@entry("selective_regret_curve", with_("perf", MEANS, LOO, "ch AS (SELECT dataset, round(score, 9) AS confidence, regret AS personal, avg(regret) OVER () AS fallback FROM loo)", "th AS (SELECT CAST(0.03 AS DOUBLE) + CAST(0.005 AS DOUBLE) * t AS threshold FROM (SELECT unnest(range(0, 9)) AS t))") + "SELECT round(threshold, 6) AS threshold, round(avg(CASE WHEN confidence >= threshold THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN confidence >= threshold THEN personal ELSE fallback END), 6) AS regret FROM ch, th GROUP BY 1")
def selective_regret_curve(s, d):
    from pyspark.sql import Window

    loo = E.leave_one_out(means(s, d))
    ch = loo.select("dataset", F.round("score", 9).alias("confidence"), F.col("regret").alias("personal"), F.avg("regret").over(Window.partitionBy()).alias("fallback"))
    return rounded(E.selective_regret(ch, s.range(9).select((0.03 + 0.005 * F.col("id")).alias("threshold"))), "threshold", "coverage", "regret")


@entry("paired_differences", with_("perf", MEANS) + "SELECT a.config AS a, b.config AS b, count(*) AS n, round(avg(a.score - b.score), 6) AS mean_diff, round(avg(CASE WHEN round(a.score - b.score, 9) > 0 THEN 1.0 ELSE 0 END), 6) AS wins FROM means a JOIN means b ON a.dataset = b.dataset AND a.config < b.config GROUP BY 1, 2")
def paired_differences(s, d):
    return rounded(E.paired_differences(means(s, d)), "mean_diff", "wins")


@entry("bootstrap_mean_interval", with_("perf", MEANS, "bt AS (SELECT config, b, sum((ascii(left(md5(b || ':' || dataset), 1)) % 4) * score) / sum(ascii(left(md5(b || ':' || dataset), 1)) % 4) AS m FROM means, (SELECT unnest(range(1, 33)) AS b) GROUP BY 1, 2)") + "SELECT config, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM bt GROUP BY 1")
def bootstrap_mean_interval(s, d):
    return rounded(E.bootstrap_means(means(s, d)), "lo", "hi")


@entry("latest_record", with_("evid") + "SELECT node, dataset, method, seed, round(score, 6) AS score, line_no FROM evid QUALIFY row_number() OVER (PARTITION BY node, dataset, method, seed ORDER BY ingested_at DESC, line_no DESC) = 1")
def latest_record(s, d):
    return rounded(E.latest(A.evidence(s, d), ["node", "dataset", "method", "seed"]).select("node", "dataset", "method", "seed", "score", "line_no"), "score")


CONS = """lab AS (SELECT dataset, method, node, avg(score) AS lab, count(*) AS n FROM evid GROUP BY 1, 2, 3),
mid AS (SELECT dataset, method, median(lab) AS consensus FROM lab GROUP BY 1, 2),
dev AS (SELECT l.*, consensus, abs(lab - consensus) AS dev FROM lab l JOIN mid USING (dataset, method)),
cons AS (SELECT dataset, method, any_value(consensus) AS consensus, count(*) AS n_labs, CAST(sum(n) AS BIGINT) AS n_records, avg(lab) AS mean, median(dev) AS mad, max(lab) - min(lab) AS spread, avg(CASE WHEN round(dev, 9) <= 0.05 THEN 1.0 ELSE 0 END) AS reproducibility,
  CASE WHEN count(*) < 2 THEN 'unverified' WHEN count(*) FILTER (WHERE round(dev, 9) <= 0.05) >= 2 THEN 'verified' ELSE 'disputed' END AS status FROM dev GROUP BY 1, 2)"""


@entry("federated_consensus", with_("evid", CONS) + "SELECT dataset, method, round(consensus, 8) AS consensus, n_labs, n_records, round(mean, 8) AS mean, round(mad, 8) AS mad, round(spread, 8) AS spread, round(reproducibility, 8) AS reproducibility, status FROM cons")
def federated_consensus(s, d):
    return rounded(E.consensus(A.evidence(s, d)), "consensus", "mean", "mad", "spread", "reproducibility", dp=8)


@entry("laboratory_track_records", with_("evid", CONS) + "SELECT node, count(*) AS cells, count(*) FILTER (WHERE status = 'verified' AND round(abs(lab - cons.consensus), 9) <= 0.05) AS reproduced, count(*) FILTER (WHERE status = 'disputed') AS disputed FROM lab JOIN cons USING (dataset, method) GROUP BY 1")
def laboratory_track_records(s, d):
    return E.track_records(A.evidence(s, d))


@entry("undisputed_landscape", with_("evid", CONS) + "SELECT dataset, method, round(consensus, 8) AS score FROM cons WHERE status <> 'disputed'")
def undisputed_landscape(s, d):
    return rounded(E.consensus(A.evidence(s, d)).filter("status <> 'disputed'").select("dataset", "method", F.col("consensus").alias("score")), "score", dp=8)


@entry("idempotent_append", with_("evid") + "SELECT node, dataset, method, seed, round(score, 6) AS score, line_no FROM (SELECT * FROM evid WHERE ingested_at >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY node, dataset, method, seed ORDER BY line_no) = 1) n WHERE NOT EXISTS (SELECT 1 FROM evid o WHERE o.ingested_at < TIMESTAMP '2024-01-15' AND o.node = n.node AND o.dataset = n.dataset AND o.method = n.method AND o.seed = n.seed)")
def idempotent_append(s, d):
    e, keys = A.evidence(s, d), ["node", "dataset", "method", "seed"]
    at = F.lit("2024-01-15").cast("timestamp")
    new = E.new_records(e.filter(F.col("ingested_at") < at), e.filter(F.col("ingested_at") >= at), keys)
    return rounded(new.select(*keys, "score", "line_no"), "score")


FT = "ft AS (SELECT dataset, [avg(score) - 0.05, avg(secs) / 50, stddev_pop(score)] AS vec, CAST(substr(dataset, 8) AS INTEGER) % 3 AS platform, CAST(substr(dataset, 8) AS INTEGER) % 2 AS task FROM perf GROUP BY 1)"


def features(s, d):
    f = A.perf(s, d).groupBy("dataset").agg(F.array(F.avg("score") - 0.05, F.avg("secs") / 50, F.stddev_pop("score")).alias("vec"))
    k = F.substring("dataset", 8, 9).cast("int")
    return f.withColumn("platform", k % 3).withColumn("task", k % 2)


@entry("missing_cells", with_("perf", "few AS (SELECT * FROM perf WHERE seed = 7)", "m AS (SELECT DISTINCT dataset, config FROM few)") + "SELECT n_name AS dataset, config FROM nation, (SELECT DISTINCT p_brand AS config FROM part) WHERE (n_name, config) NOT IN (SELECT (dataset, config) FROM m)")
def missing_cells(s, d):
    m = E.mean_scores(A.perf(s, d).filter("seed = 7"))
    return E.missing_cells(m, A.table(s, d, "nation").select(F.col("n_name").alias("dataset")), A.table(s, d, "part").select(F.col("p_brand").alias("config")).distinct())


SW = "sw AS (SELECT config, seed AS level, round(avg(score), 9) AS score FROM perf GROUP BY 1, 2)"


@entry("first_crossing", with_("perf", SW, "ld AS (SELECT *, lead(level) OVER w AS l2, lead(score) OVER w AS s2 FROM sw WINDOW w AS (PARTITION BY config ORDER BY level))") + "SELECT config, round(arg_min(level + (score - 0.05) / (score - s2) * (l2 - level), level), 6) AS boundary FROM ld WHERE score >= 0.05 AND s2 < 0.05 GROUP BY 1")
def first_crossing(s, d):
    sw = A.perf(s, d).groupBy("config", F.col("seed").alias("level")).agg(F.round(F.avg("score"), 9).alias("score"))
    return rounded(E.first_crossing(sw, 0.05), "boundary")


@entry("failure_modes", with_("pts", "ct AS (SELECT label AS truth, pred, count(*) AS n FROM pts GROUP BY 1, 2)", "s AS (SELECT *, n / sum(n) OVER (PARTITION BY truth) AS ot, n / sum(n) OVER (PARTITION BY pred) AS op FROM ct)", "a AS (SELECT max(k) AS most_fragments, avg(k) AS mean_fragments FROM (SELECT count(*) AS k FROM s WHERE ot >= 0.05 GROUP BY truth))", "b AS (SELECT max(k) AS most_merged, avg(k) AS mean_merged FROM (SELECT count(*) AS k FROM s WHERE op >= 0.05 GROUP BY pred))") + "SELECT most_fragments, round(mean_fragments, 6) AS mean_fragments, most_merged, round(mean_merged, 6) AS mean_merged, round((SELECT sum(CASE WHEN ot < 0.05 THEN n ELSE 0 END) / sum(n) FROM s), 6) AS noise, most_fragments >= 5 AS fragmented, most_merged >= 3 AS merged FROM a, b")
def failure_modes(s, d):
    return rounded(E.failure_modes(labels.contingency(A.points(s, d))), "mean_fragments", "mean_merged", "noise")


@entry("complexity_fit", with_("perf", "g AS (SELECT config, ln(secs) AS lx, ln(score) AS ly FROM perf WHERE secs > 0 AND score > 0)") + "SELECT config, round(regr_slope(ly, lx), 6) AS exponent, round(regr_intercept(ly, lx), 6) AS intercept, round(regr_r2(ly, lx), 6) AS r2, count(*) AS n FROM g GROUP BY 1")
def complexity_fit(s, d):
    return rounded(E.complexity(A.perf(s, d), "secs", "score", "config"), "exponent", "intercept", "r2")


@entry("evidence_admissibility", """WITH m AS (SELECT c_nationkey AS dataset, CASE WHEN c_nationkey % 2 = 0 THEN 'Domains' ELSE 'svg' END AS task, min(c_mktsegment) AS truth, count(*) AS n FROM customer GROUP BY 1)
SELECT dataset, task, truth, n, concat_ws(',', CASE WHEN lower(task) <> 'domains' THEN 'task' END, CASE WHEN truth NOT IN ('AUTOMOBILE') THEN 'ground_truth' END, CASE WHEN n < 2 THEN 'support' END) AS reasons, lower(task) = 'domains' AND truth IN ('AUTOMOBILE') AND n >= 2 AS admitted FROM m""")
def evidence_admissibility(s, d):
    m = A.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("dataset")).agg(F.min("c_mktsegment").alias("truth"), F.count("*").alias("n"))
    m = m.select("dataset", F.when(F.col("dataset") % 2 == 0, "Domains").otherwise("svg").alias("task"), "truth", "n")
    return E.admissible(m, "domains", ("AUTOMOBILE",))


@entry("capability_index", with_("perf", "g AS (SELECT config, avg(score) * 10 AS recovery, 1 - stddev_pop(score) AS robustness, CASE WHEN min(seed) = 1 THEN avg(CASE WHEN status = 'N' THEN 1.0 ELSE 0 END) END AS reliability, NULLIF(avg(secs) / 50, 0) AS efficiency FROM perf GROUP BY 1)") + "SELECT config, round((recovery * 0.5 + robustness * 0.25 + coalesce(reliability, 0) * 0.15 + coalesce(efficiency, 0) * 0.1) / (0.75 + CASE WHEN reliability IS NULL THEN 0 ELSE 0.15 END + CASE WHEN efficiency IS NULL THEN 0 ELSE 0.1 END), 6) AS capability FROM g")
def capability_index(s, d):
    g = A.perf(s, d).groupBy("config").agg((F.avg("score") * 10).alias("recovery"), (1 - F.stddev_pop("score")).alias("robustness"), F.when(F.min("seed") == 1, F.avg(F.when(F.col("status") == "N", 1.0).otherwise(0.0))).alias("reliability"), (F.avg("secs") / 50).alias("efficiency"))
    return rounded(E.capability(g, {"recovery": 0.5, "robustness": 0.25, "reliability": 0.15, "efficiency": 0.1}), "capability").select("config", "capability")


@entry("three_level_rollup", with_("perf", "a AS (SELECT dataset, config, seed, avg(score) AS s FROM perf GROUP BY 1, 2, 3)", "b AS (SELECT dataset, config, avg(s) AS s, count(DISTINCT seed) AS seeds FROM a GROUP BY 1, 2)") + "SELECT config, round(avg(s), 6) AS score, count(DISTINCT dataset) AS datasets, CAST(sum(seeds) AS BIGINT) AS seeds FROM b GROUP BY 1")
def three_level_rollup(s, d):
    a = A.perf(s, d).groupBy("dataset", "config", "seed").agg(F.avg("score").alias("s"))
    b = a.groupBy("dataset", "config").agg(F.avg("s").alias("s"), F.countDistinct("seed").alias("seeds"))
    return rounded(b.groupBy("config").agg(F.avg("s").alias("score"), F.countDistinct("dataset").alias("datasets"), F.sum("seeds").alias("seeds")), "score")


@entry("best_config_per_dataset", with_("perf", MEANS) + "SELECT dataset, arg_min(config, (-round(score, 9), config)) AS config, round(max(score), 6) AS score FROM means GROUP BY 1")
def best_config_per_dataset(s, d):
    return rounded(means(s, d).groupBy("dataset").agg(F.min_by("config", F.struct(-F.round("score", 9), "config")).alias("config"), F.max("score").alias("score")), "score")


@entry("zscore_within_group", with_("perf", MEANS) + "SELECT dataset, config, round(CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 5) AS z FROM means WINDOW w AS (PARTITION BY dataset)")
def zscore_within_group(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset")
    sd = F.stddev_pop("score").over(w)
    return rounded(means(s, d).select("dataset", "config", F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0).alias("z")), "z", dp=5)


@entry("percent_rank_first_come", with_("perf", MEANS) + "SELECT dataset, config, round(row_number() OVER (PARTITION BY dataset ORDER BY round(score, 9), config) / count(*) OVER (PARTITION BY dataset)::DOUBLE, 6) AS pr FROM means")
def percent_rank_first_come(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset")
    return rounded(means(s, d).select("dataset", "config", (F.row_number().over(w.orderBy(F.round("score", 9), "config")) / F.count("*").over(w)).alias("pr")), "pr")


@entry("majority_label", with_("pts", "c AS (SELECT pred, label, count(*) AS n FROM pts GROUP BY 1, 2)") + "SELECT pred, label, n FROM c QUALIFY row_number() OVER (PARTITION BY pred ORDER BY n DESC, label) = 1")
def majority_label(s, d):
    c = A.points(s, d).groupBy("pred", "label").agg(F.count("*").alias("n"))
    return c.groupBy("pred").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label")).alias("m")).select("pred", "m.label", "m.n")


@entry("memory_by_largest_scale", with_("perf") + "SELECT config, arg_max(secs, (seed, secs)) / 10 AS memory_gb FROM perf WHERE lower(status) NOT IN ('r') GROUP BY 1")
def memory_by_largest_scale(s, d):
    return longtable.memory_by_scale(A.perf(s, d).select(F.col("config").alias("method"), F.col("seed").alias("n"), (F.col("secs") / 10).alias("memory_gb"), "status"), ("r",)).select(F.col("method").alias("config"), "memory_gb")


@entry("edge_set_agreement", with_("pts", A.knn_sql(6), A.knn_sql(8, "kn8"), "a AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM knn)", "b AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM kn8)", "x AS (SELECT count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b))") + "SELECT round(n / (SELECT count(*) FROM b)::DOUBLE, 6) AS precision, round(n / (SELECT count(*) FROM a)::DOUBLE, 6) AS recall FROM x")
def edge_set_agreement(s, d):
    from ..operators import graph

    p = A.points(s, d)
    wide = graph.knn(p, 8)
    a, b = graph.undirected(wide.filter("r <= 6")), graph.undirected(wide)
    n = lambda x, c: x.agg(F.count("*").alias(c))
    out = n(a.intersect(b), "n").crossJoin(n(a, "a")).crossJoin(n(b, "b"))
    return rounded(out.select((F.col("n") / F.col("b")).alias("precision"), (F.col("n") / F.col("a")).alias("recall")), "precision", "recall")


@entry("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s, d):
    from ..streaming.events import hourly

    return rounded(hourly(A.table(s, d, "events")), "total", dp=4)


@entry("event_stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_stream_windows(s, d):
    """The same through a stream that reads the table as files and stops when it has read all."""
    from ..streaming.events import run_hourly

    return rounded(run_hourly(s, f"{d}/events.parquet"), "total", dp=4)
