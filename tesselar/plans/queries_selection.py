"""Registered queries of rank resampling, the fixed-split selector and the policies on held-out units, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import recommend as R
from ..operators import selection as S
from . import adapters as A
from .adapters import with_
from .queries_evidence import MEANS, means
from .queries_matrix import rounded
from .queries_recommend import KNOWN, META, RANKED, known, meta, near
from .tables import saved

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DRAWS = 200


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _weight(draw: str, unit: str) -> str:
    u = f"(CAST('0x' || left(md5({draw} || ':' || {unit}), 8) AS UBIGINT) / 4294967296.0)"
    return "CASE " + " ".join(f"WHEN {u} < {p!r} THEN {k}" for k, p in enumerate(S.POISSON)) + f" ELSE {len(S.POISSON)} END"


def _draws(source: str, unit: str) -> str:
    """``wt``: how often each draw takes each unit."""
    return f"wt AS (SELECT * FROM (SELECT b, {unit} AS unit, {_weight('b', unit)} AS w FROM (SELECT DISTINCT {unit} FROM {source}), (SELECT unnest(range(1, {DRAWS + 1})) AS b)) WHERE w > 0)"


RANKS = (
    _draws("means", "dataset"),
    f"""rk AS (SELECT b, config, CASE WHEN m IS NULL THEN count(*) OVER (PARTITION BY b)::DOUBLE ELSE rank() OVER (PARTITION BY b ORDER BY m DESC NULLS LAST) + (count(*) OVER (PARTITION BY b, m) - 1) / 2.0 END AS rank
  FROM (SELECT b, config FROM (SELECT DISTINCT config FROM means), (SELECT unnest(range(1, {DRAWS + 1})) AS b)) g LEFT JOIN (SELECT b, config, round(sum(w * score) / sum(w), 9) AS m FROM means JOIN wt ON unit = dataset GROUP BY 1, 2) x USING (b, config)),
nm AS (SELECT count(DISTINCT config) AS m FROM means)""",
)


def _scores(s, d):
    return means(s, d).select(F.col("dataset").alias("unit"), "config", "score")


@entry("rank_stability", with_("perf", MEANS, *RANKS) + f"""SELECT config, round((SELECT avg(score) FROM means x WHERE x.config = rk.config), 6) AS mean_score, round(avg(rank), 6) AS mean_rank, round(quantile_cont(rank, 0.025), 6) AS rank_ci_low, round(quantile_cont(rank, 0.975), 6) AS rank_ci_high,
  round((count(*) FILTER (WHERE round_even(rank, 0) = 1) + 1.0) / ({DRAWS} + (SELECT m FROM nm)), 6) AS p_best, round(least(greatest(1 - (quantile_cont(rank, 0.75) - quantile_cont(rank, 0.25)) / greatest((SELECT m FROM nm) - 1, 1), 0), 1), 6) AS rank_stability FROM rk GROUP BY config""")
def rank_stability(s, d):
    return rounded(S.rank_stability(_scores(s, d), DRAWS), "mean_score", "mean_rank", "rank_ci_low", "rank_ci_high", "p_best", "rank_stability")


@entry("rank_posterior", with_("perf", MEANS, *RANKS) + f"""SELECT g.config, CAST(r AS INTEGER) AS rank, round((count(rk.rank) + 1.0) / ({DRAWS} + (SELECT m FROM nm)), 6) AS mass
  FROM (SELECT config, r FROM (SELECT DISTINCT config FROM means), (SELECT unnest(range(1, m + 1)) AS r FROM nm)) g LEFT JOIN rk ON rk.config = g.config AND round_even(rk.rank, 0) = r GROUP BY 1, 2""")
def rank_posterior(s, d):
    return rounded(S.rank_posterior(_scores(s, d), DRAWS), "mass")


@entry("review_landscape", with_("perf", MEANS, "df AS (SELECT a.config AS a, b.config AS b, a.dataset, round(a.score - b.score, 9) AS d FROM means a JOIN means b ON a.dataset = b.dataset AND a.config < b.config)", "fl AS (SELECT a, b, f, abs(avg(CASE WHEN left(md5(f || ':' || dataset), 1) < '8' THEN d ELSE -d END)) AS m, abs(avg(d)) AS o, avg(d) AS e FROM df, (SELECT unnest(range(1, 65)) AS f) GROUP BY 1, 2, 3)",
  "pv AS (SELECT a, b, any_value(e) AS e, (sum(CASE WHEN m >= o - 1e-12 THEN 1 ELSE 0 END) + 1.0) / 65 AS p FROM fl GROUP BY 1, 2)", "rn AS (SELECT *, row_number() OVER (ORDER BY p, a || '|' || b) AS r, count(*) OVER () AS n FROM pv)",
  "qv AS (SELECT *, least(min(p * n / r) OVER (ORDER BY p, a || '|' || b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM rn)") + "SELECT a, b, round(e, 6) AS mean_difference, round(p, 6) AS p, round(q, 6) AS q, round(q, 9) <= 0.05 AS significant FROM qv")
def review_landscape(s, d):
    """Every pair of configurations: mean difference, sign-flip p and what is left of it among all pairs."""
    m = means(s, d)
    one, two = (m.select("dataset", F.col("config").alias(c), F.col("score").alias("s" + c)) for c in "ab")
    diffs = saved(one.join(two, "dataset").filter("a < b").select("a", "b", "dataset", F.round(F.col("sa") - F.col("sb"), 9).alias("d")), "differences")
    p = E.sign_flip_p(diffs).join(diffs.groupBy("a", "b").agg(F.avg("d").alias("mean_difference")), ["a", "b"]).withColumn("pair", F.concat_ws("|", "a", "b"))
    q = E.step_up(p, "p", "q", "pair").withColumn("significant", F.round("q", 9) <= 0.05)
    return rounded(q.select("a", "b", "mean_difference", "p", "q", "significant"), "mean_difference", "p", "q")


# --- the selector: units are data sets under one seed, configurations families of brands, features what is known without scores

UNITS = """ps AS (SELECT dataset || '/' || seed AS unit, left(config, 7) AS config, avg(score) AS score FROM perf GROUP BY 1, 2),
fe AS (SELECT dataset || '/' || seed AS unit, avg(secs) AS f1, avg(CASE WHEN status = 'R' THEN 1.0 ELSE 0.0 END) AS f2 FROM perf GROUP BY 1),
sc AS (SELECT * FROM ps WHERE unit IN (SELECT unit FROM ps GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT config) FROM ps))),
un AS (SELECT unit, f1, f2, CASE WHEN left(md5(unit), 1) < '8' THEN 'development' WHEN left(md5(unit), 1) < 'c' THEN 'calibration' ELSE 'test' END AS fold FROM fe WHERE unit IN (SELECT unit FROM sc)),
mo AS (SELECT avg(f1) AS m1, avg(f2) AS m2, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2, count(*) AS n FROM un WHERE fold = 'development'),
zz AS (SELECT unit, fold, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2 FROM un, mo),
gr AS (SELECT sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS c, sum(z2 * z2) + 1 AS e FROM zz WHERE fold = 'development'),
be AS (SELECT config, base, (e * b1 - c * b2) / (a * e - c * c) AS w1, (a * b2 - c * b1) / (a * e - c * c) AS w2 FROM (SELECT config, avg(score) AS base, sum(z1 * score) AS b1, sum(z2 * score) AS b2 FROM zz JOIN sc USING (unit) WHERE fold = 'development' GROUP BY 1), gr),
pr AS (SELECT unit, fold, config, score, round(base + w1 * z1 + w2 * z2, 9) AS p FROM zz JOIN sc USING (unit) JOIN be USING (config)),
gl AS (SELECT arg_min(config, (-m, config)) AS g FROM (SELECT config, round(avg(score), 9) AS m FROM pr WHERE fold = 'development' GROUP BY 1)),
ch AS (SELECT unit, fold, g, arg_min(config, (-p, config)) AS selected, max(score) AS best, arg_min(score, (-p, config)) AS score, max(score) FILTER (WHERE config = g) AS gscore, max(p) - max(p) FILTER (WHERE config = g) AS gain FROM pr, gl GROUP BY 1, 2, 3)"""
THRESHOLDS = (0.0, 0.0005, 0.001, 0.002, 0.005)
CALIBRATED = (
    "th AS (SELECT unnest([0.0, 0.0005, 0.001, 0.002, 0.005])::DOUBLE AS threshold)",
    "de AS (SELECT threshold, unit, selected <> g AND gain >= threshold AS covered, CASE WHEN selected <> g AND gain >= threshold THEN gscore - score ELSE 0 END AS delta FROM ch, th WHERE fold = 'calibration')",
    _draws("ch", "unit"),
    """ci AS (SELECT threshold, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT threshold, b, sum(w * delta) / sum(w) AS m FROM de JOIN wt USING (unit) GROUP BY 1, 2) GROUP BY 1),
ca AS (SELECT threshold, avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END) AS coverage, avg(delta) AS md FROM de GROUP BY 1),
el AS (SELECT *, coverage >= 0.2 AND round(md, 12) <= 0 AND ci_high <= 0.02 AS eligible FROM ca JOIN ci USING (threshold)),
po AS (SELECT *, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY coverage DESC, round(md, 12), threshold DESC) = 1 AS frozen FROM el)""",
)
ACTIONS = """tf AS (SELECT max(threshold) AS t FROM po WHERE frozen),
ac AS (SELECT unit, CASE WHEN t IS NULL THEN NULL WHEN selected <> g AND gain >= t THEN selected ELSE g END AS selected_config, CASE WHEN t IS NULL THEN 'evidence_required' WHEN selected <> g AND gain >= t THEN 'personalised_set' ELSE 'global_default' END AS action,
  CASE WHEN t IS NOT NULL THEN gain END AS gain, t FROM ch, tf WHERE fold = 'test')"""


def _selector(s, d):
    p = A.perf(s, d).withColumn("unit", F.concat_ws("/", "dataset", "seed"))
    scores = p.groupBy("unit", F.substring("config", 1, 7).alias("config")).agg(F.avg("score").alias("score"))
    letter = F.substring(F.md5("unit"), 1, 1)
    units = p.groupBy("unit").agg(F.array(F.avg("secs"), F.avg(F.when(F.col("status") == "R", 1.0).otherwise(0.0))).alias("vec")).withColumn("fold", F.when(letter < "8", "development").when(letter < "c", "calibration").otherwise("test"))
    scored = saved(S.predicted(saved(units, "units"), saved(scores, "scores")), "scored")
    chosen = saved(S.choices(scored), "chosen")
    return scored, chosen, saved(S.calibrated(chosen, list(THRESHOLDS), draws=DRAWS), "policy")


@entry("selector_calibration", with_("perf", UNITS, *CALIBRATED) + "SELECT threshold, round(coverage, 6) AS coverage, round(md, 9) AS mean_regret_difference, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, eligible, frozen FROM po")
def selector_calibration(s, d):
    return rounded(rounded(_selector(s, d)[2], "coverage"), "mean_regret_difference", "ci_low", "ci_high", dp=9)


@entry("selector_actions", with_("perf", UNITS, *CALIBRATED, ACTIONS) + "SELECT unit, selected_config, action, round(gain, 9) AS predicted_gain, t AS threshold FROM ac")
def selector_actions(s, d):
    _, chosen, policy = _selector(s, d)
    return rounded(S.actions(chosen, policy), "predicted_gain", dp=9)


@entry("selector_evaluation", with_("perf", UNITS, *CALIBRATED, ACTIONS) + """SELECT CASE WHEN count(*) FILTER (WHERE pr.score IS NULL) > 0 THEN 'evidence_required' ELSE 'scored' END AS status, count(*) AS n_units, CASE WHEN count(*) FILTER (WHERE pr.score IS NULL) > 0 THEN 0.0 ELSE round(avg(CASE WHEN selected_config <> g THEN 1.0 ELSE 0.0 END), 6) END AS coverage,
  CASE WHEN count(*) FILTER (WHERE pr.score IS NULL) = 0 THEN round(avg(best - pr.score), 9) END AS mean_deployed_regret, CASE WHEN count(*) FILTER (WHERE pr.score IS NULL) = 0 THEN round(avg(best - gscore), 9) END AS mean_global_regret, CASE WHEN count(*) FILTER (WHERE pr.score IS NULL) = 0 THEN round(avg(gscore - pr.score), 9) END AS mean_regret_difference
  FROM ac JOIN ch USING (unit) LEFT JOIN pr ON pr.unit = ac.unit AND pr.config = selected_config""")
def selector_evaluation(s, d):
    scored, chosen, policy = _selector(s, d)
    return rounded(rounded(S.evaluated(S.actions(chosen, policy), scored, chosen), "coverage"), "mean_deployed_regret", "mean_global_regret", "mean_regret_difference", dp=9)


# --- policies: units are data sets, the neighbours' ranking is the recommender's

POLICIES = (META, KNOWN, RANKED, """tt AS (SELECT config, sum(score) AS s, count(*) AS n FROM kn GROUP BY 1), hd AS (SELECT dataset AS unit, max(score) AS oracle, avg(score) AS rnd FROM kn GROUP BY 1),
tr AS (SELECT unit, tt.config, kn.score, round((s - coalesce(kn.score, 0)) / (n - CASE WHEN kn.score IS NULL THEN 0 ELSE 1 END), 9) AS train FROM hd CROSS JOIN tt LEFT JOIN kn ON kn.dataset = unit AND kn.config = tt.config WHERE n - CASE WHEN kn.score IS NULL THEN 0 ELSE 1 END > 0),
gb AS (SELECT unit, arg_max(config, (train, config)) AS gm, max(train) AS gt FROM tr GROUP BY 1), gs AS (SELECT gb.*, score AS gscore FROM gb JOIN tr ON tr.unit = gb.unit AND tr.config = gm),
pp AS (SELECT gs.unit, oracle, rnd, gm, gscore, rk.config AS km, kn.score AS kscore, coalesce(confidence, 0) AS conf, coalesce(round(rk.score - gt - 0.02, 9) >= 0, FALSE) AS beats, coalesce(round(rk.score - gt - 0.02, 9) >= 0, FALSE) AND coalesce(confidence >= 0.2, FALSE) AS gate
  FROM gs JOIN hd USING (unit) LEFT JOIN rk ON rk.q = gs.unit AND rk.rank = 1 LEFT JOIN kn ON kn.dataset = gs.unit AND kn.config = rk.config WHERE (SELECT count(*) - 1 FROM hd) >= 4),
pl AS (SELECT unit, oracle, gm AS global_method, oracle - gscore AS global_regret, km AS knn_method, oracle - kscore AS knn_regret, conf AS knn_confidence, beats AS knn_beats_global_proxy, CASE WHEN gate THEN km ELSE gm END AS gated_method, oracle - CASE WHEN gate THEN kscore ELSE gscore END AS gated_regret,
  CASE WHEN gate THEN 'personalised' ELSE 'global_default' END AS gated_action, oracle - rnd AS random_regret FROM pp)""")
LONG = "lg AS (SELECT unit, 'global' AS policy, global_regret AS regret, global_regret FROM pl UNION ALL SELECT unit, 'knn', knn_regret, global_regret FROM pl UNION ALL SELECT unit, 'gated', gated_regret, global_regret FROM pl)"


def _policies(s, d):
    k = saved(known(s, d), "known")
    ranked = saved(R.ranked_methods(near(s, d), k, "high"), "ranked")
    scores = k.select(F.col("dataset").alias("unit"), "config", "score")
    return scores, saved(S.held_out_policies(scores, ranked), "policies")


@entry("personalisation_policies", with_("perf", *POLICIES) + "SELECT unit, round(oracle, 9) AS oracle, global_method, round(global_regret, 9) AS global_regret, knn_method, round(knn_regret, 9) AS knn_regret, knn_confidence, knn_beats_global_proxy, gated_method, round(gated_regret, 9) AS gated_regret, gated_action, round(random_regret, 9) AS random_regret FROM pl")
def personalisation_policies(s, d):
    return rounded(_policies(s, d)[1], "oracle", "global_regret", "knn_regret", "gated_regret", "random_regret", dp=9)


@entry("policy_noninferiority", with_("perf", *POLICIES, LONG, _draws("pl", "unit"), "dl AS (SELECT policy, unit, regret - global_regret AS delta FROM lg WHERE policy <> 'global' AND regret IS NOT NULL AND global_regret IS NOT NULL)",
  "bb AS (SELECT policy, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg(CASE WHEN round(m, 12) <= 0 THEN 1.0 ELSE 0.0 END) AS p0 FROM (SELECT policy, b, sum(w * delta) / sum(w) AS m FROM dl JOIN wt USING (unit) GROUP BY 1, 2) GROUP BY 1)",
  "mm AS (SELECT policy, avg(regret) AS mr, avg(global_regret) AS mg FROM lg WHERE policy <> 'global' GROUP BY 1)") + """SELECT policy, (SELECT count(*) FROM dl WHERE dl.policy = mm.policy) AS n, round(mr, 9) AS mean_regret, round(mg, 9) AS mean_global_regret, round((SELECT avg(delta) FROM dl WHERE dl.policy = mm.policy), 9) AS mean_delta, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high,
  round(p0, 6) AS prob_delta_le_0, CASE WHEN policy = 'knn' THEN 1.0 ELSE (SELECT round(avg(CASE WHEN gated_action = 'personalised' THEN 1.0 ELSE 0.0 END), 6) FROM pl) END AS personalised_rate, round(mr - mg, 9) <= 0.02 AS noninferior, round(hi, 9) <= 0.02 AS statistical_noninferior, round(mr - mg, 9) < 0 AS superior FROM mm JOIN bb USING (policy)""")
def policy_noninferiority(s, d):
    return rounded(rounded(S.policy_summary(_policies(s, d)[1], draws=DRAWS), "mean_regret", "mean_global_regret", "mean_delta", "ci_low", "ci_high", dp=9), "prob_delta_le_0", "personalised_rate")


@entry("policy_regret_intervals", with_("perf", *POLICIES, LONG, _draws("pl", "unit"), "bb AS (SELECT policy, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT policy, b, sum(w * regret) / sum(w) AS m FROM lg JOIN wt USING (unit) WHERE regret IS NOT NULL GROUP BY 1, 2) GROUP BY 1)")
  + "SELECT policy, count(regret) AS n, round(avg(regret), 9) AS mean, round(any_value(lo), 9) AS ci_low, round(any_value(hi), 9) AS ci_high, round(coalesce(stddev_samp(regret), 0), 9) AS std FROM lg JOIN bb USING (policy) GROUP BY 1")
def policy_regret_intervals(s, d):
    return rounded(S.regret_intervals(_policies(s, d)[1], DRAWS), "mean", "ci_low", "ci_high", "std", dp=9)


@entry("policies_by_region", with_("perf", *POLICIES) + "SELECT r_name AS class, count(*) AS n, round(avg(global_regret), 9) AS mean_global_regret, round(avg(knn_regret), 9) AS mean_knn_regret, round(avg(gated_regret), 9) AS mean_gated_regret, round(avg(CASE WHEN gated_action = 'personalised' THEN 1.0 ELSE 0.0 END), 6) AS personalised_rate FROM pl JOIN nation ON n_name = unit JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def policies_by_region(s, d):
    """A data set's class is its region."""
    classes = A.table(s, d, "nation").join(A.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("unit"), F.col("r_name").alias("class"))
    return rounded(rounded(S.policies_by_class(_policies(s, d)[1], classes), "mean_global_regret", "mean_knn_regret", "mean_gated_regret", dp=9), "personalised_rate")


@entry("unit_rank_concordance", with_("perf", META, KNOWN, """ro AS (SELECT * FROM (SELECT dataset, config, row_number() OVER (PARTITION BY dataset ORDER BY round(score, 9) DESC, config) AS r, count(*) OVER (PARTITION BY dataset) AS k FROM kn) WHERE k > 1),
kk AS (SELECT (SELECT count(DISTINCT dataset) FROM ro) AS u, (SELECT count(DISTINCT config) FROM kn) AS m), ss AS (SELECT g.config, coalesce(sum(r), 0) + (u - count(r)) * m AS s, u, m FROM (SELECT DISTINCT config FROM kn) g CROSS JOIN kk LEFT JOIN ro ON ro.config = g.config GROUP BY g.config, u, m)""")
  + "SELECT any_value(u) AS n_units, any_value(m) AS n_methods, round(12.0 * var_pop(s) * any_value(m) / (any_value(u) * any_value(u) * (power(any_value(m), 3) - any_value(m))), 6) AS kendall_w FROM ss")
def unit_rank_concordance(s, d):
    return rounded(S.rank_concordance(_policies(s, d)[0]), "kendall_w")
