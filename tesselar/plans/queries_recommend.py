"""Registered queries of the recommender and the decision card, for every data set as a request, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import recommend as R
from ..plans.tables import saved
from . import adapters as A
from .adapters import with_
from .queries_evidence import features
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


def meta(s, d):
    """Data sets with platforms as laboratories write them, tasks, ground truths and K policies of all kinds, by number."""
    k = F.substring("dataset", 8, 9).cast("int")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    f = features(s, d).select("dataset", "vec")
    return f.select(
        "dataset", "vec", pick(3, "10x_Visium", "Visium", "MERSCOPE").alias("platform"), F.when(k % 4 == 3, "SVG").otherwise("domain_detection").alias("task"),
        F.when(k % 11 == 10, "leiden").when(k % 4 == 3, "none").otherwise("spatial_domain").alias("truth"), F.when(k % 7 == 6, "oracle").when(k % 13 == 12, "").otherwise("Estimate").alias("k_policy"), F.lit(False).alias("oracle_k"),
    )


def known(s, d):
    """Mean scores with a policy in some names; every fourth cell is missing, by rule, to leave something to measure."""
    p = A.perf(s, d).withColumn("b", F.substring("config", 7, 2).cast("int")).withColumn("k", F.substring("dataset", 8, 9).cast("int"))
    name = F.concat("config", F.when(F.col("b") % 10 <= 2, "@sw0.8").when(F.col("b") % 10 == 3, "@sw0.3").otherwise(""))
    return p.filter((F.col("b") + F.col("k")) % 4 != 0).groupBy("dataset", name.alias("config")).agg(F.round(F.avg("score"), 9).alias("score"), F.round(F.avg("secs"), 9).alias("secs"))


META = """mt AS (SELECT dataset, [avg(score) - 0.05, avg(secs) / 50, stddev_pop(score)] AS vec, CAST(substr(dataset, 8) AS INTEGER) AS k FROM perf GROUP BY 1),
au AS (SELECT b.dataset AS q, b.k AS qk, a.dataset, a.k, least(greatest((list_cosine_similarity(a.vec, b.vec) + 1) / 2, 0), 1) AS raw,
  CASE WHEN (a.k % 4 = 3) <> (b.k % 4 = 3) THEN ['task_mismatch'] ELSE [] END
  || CASE WHEN a.k % 11 = 10 OR (a.k % 4 = 3) <> (b.k % 4 = 3) THEN ['ground_truth_incompatible_or_missing'] ELSE [] END
  || CASE WHEN b.k % 4 = 3 THEN [] WHEN a.k % 7 = 6 THEN ['oracle_k_forbidden'] WHEN a.k % 13 = 12 THEN ['k_policy_missing'] ELSE [] END AS reasons,
  (a.k % 3 = 2) = (b.k % 3 = 2) AS same_platform FROM mt a JOIN mt b ON a.dataset <> b.dataset),
si AS (SELECT *, CASE WHEN len(reasons) = 0 THEN least(raw * CASE WHEN same_platform THEN 1.35 ELSE 1.0 END * 1.5, 1.0) ELSE 0 END AS sim FROM au),
nr AS (SELECT q, dataset, round(sim, 4) AS similarity, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, dataset DESC) AS rank FROM si WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, dataset DESC) <= 3)"""
KNOWN = """kn AS (SELECT dataset, config || CASE WHEN b % 10 <= 2 THEN '@sw0.8' WHEN b % 10 = 3 THEN '@sw0.3' ELSE '' END AS config, round(avg(score), 9) AS score, round(avg(secs), 9) AS secs
  FROM (SELECT *, CAST(substr(config, 7, 2) AS INTEGER) AS b, CAST(substr(dataset, 8) AS INTEGER) AS k FROM perf) WHERE (b + k) % 4 <> 0 GROUP BY 1, 2)"""
RANKED = """bs AS (SELECT dataset, arg_min(config, (-score, config)) AS best FROM kn GROUP BY 1), tw AS (SELECT q, sum(similarity) AS tot FROM nr GROUP BY 1),
ag AS (SELECT q, config, sum(similarity) AS w, sum(similarity * similarity) AS w2, sum(similarity * score) / sum(similarity) AS sc, avg(similarity) AS mw, count(*) AS support, count(*) FILTER (WHERE best = config) AS wins,
  greatest(sum(similarity * score * score) / sum(similarity) - (sum(similarity * score) / sum(similarity)) * (sum(similarity * score) / sum(similarity)), 0) AS var FROM nr JOIN kn USING (dataset) JOIN bs USING (dataset) GROUP BY 1, 2),
rs AS (SELECT q, config, split_part(config, '@', 1) AS method, round(sc + CASE WHEN contains(config, 'sw0.8') THEN 0.02 WHEN contains(config, '@') THEN 0 ELSE 0.005 END, 4) AS score, round(sqrt(var / greatest(w * w / w2, 1)), 4) AS uncertainty,
  round(w / tot, 4) AS coverage, support, wins, round(least(mw * w / tot * least(1, w * w / w2 / 2), 1), 4) AS confidence FROM ag JOIN tw USING (q)),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, config) AS rank FROM rs)"""
BASE = """gl AS (SELECT q, arg_min(config, (-round(m, 9), config)) AS gb FROM (SELECT mt.dataset AS q, config, avg(score) AS m FROM mt JOIN kn ON kn.dataset <> mt.dataset GROUP BY 1, 2) GROUP BY 1),
fi AS (SELECT q, config AS chosen FROM rk WHERE rank = 1),
pb AS (SELECT q, dataset, any_value(chosen) AS chosen, any_value(gb) AS gb, max(score) AS o, max(score) FILTER (WHERE config = chosen) AS c, max(score) FILTER (WHERE config = gb) AS g FROM nr JOIN kn USING (dataset) JOIN fi USING (q) JOIN gl USING (q) GROUP BY 1, 2),
ba AS (SELECT q, any_value(chosen) AS chosen, any_value(gb) AS gb, round(avg(o) - avg(c), 4) AS regret_oracle, round(avg(g) - avg(c), 4) AS regret_global, round(avg(g) - avg(c), 9) < 0 AS beats_global FROM pb GROUP BY 1)"""


def near(s, d):
    m = meta(s, d)
    return saved(R.near_references(R.audited(m, m)), "near")


@entry("admissible_references", with_("perf", META) + "SELECT q, dataset, round(raw, 6) AS raw, array_to_string(reasons, ',') AS reasons, round(sim, 6) AS similarity FROM si")
def admissible_references(s, d):
    m = meta(s, d)
    return rounded(R.audited(m, m).select("q", "dataset", "raw", F.array_join("reasons", ",").alias("reasons"), "similarity"), "raw", "similarity")


@entry("recommended_references", with_("perf", META) + "SELECT q, dataset, similarity, CAST(rank AS INTEGER) AS rank FROM nr")
def recommended_references(s, d):
    return near(s, d)


@entry("recommended_configurations", with_("perf", META, KNOWN, RANKED) + "SELECT q, config, method, score, uncertainty, coverage, support, wins, confidence, CAST(rank AS INTEGER) AS rank FROM rk")
def recommended_configurations(s, d):
    return R.ranked_methods(near(s, d), known(s, d), "high")


def _parts(s, d):
    m, k, n = saved(meta(s, d), "meta"), saved(known(s, d), "known"), near(s, d)
    r = saved(R.ranked_methods(n, k, "high"), "ranked")
    return m, k, n, r, saved(R.baseline(n, r, k, R.global_bests(k, m)), "baseline")


@entry("baseline_diagnostics", with_("perf", META, KNOWN, RANKED, BASE) + "SELECT q, chosen, gb AS global, regret_oracle, regret_global, beats_global FROM ba")
def baseline_diagnostics(s, d):
    return _parts(s, d)[4]


@entry("evidence_acquisition", with_("perf", META, KNOWN, RANKED, BASE, """ce AS (SELECT ba.q, mt.dataset, cf.config, chosen, gb FROM ba JOIN mt ON mt.dataset <> ba.q, (SELECT DISTINCT config FROM kn) cf WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.dataset = mt.dataset AND kn.config = cf.config)),
im AS (SELECT ce.*, coalesce(similarity, 0.05) AS sim, greatest(0.05, coalesce(0.15 + 0.7 * (1 - (rk.rank - 1) / (count(*) OVER (PARTITION BY ce.q) * 0 + nn.n)) + 0.25 * uncertainty, 0), CASE WHEN coalesce(rk.rank, 6) <= 5 OR ce.config IN (chosen, gb) THEN 0.55 ELSE 0 END, CASE WHEN ce.config = gb THEN 0.75 ELSE 0 END) AS imp,
  CASE WHEN ce.config IN (chosen, gb) THEN 0.5 ELSE 0 END + CASE WHEN chosen <> gb AND ce.config IN (chosen, gb) AND EXISTS (SELECT 1 FROM kn WHERE kn.dataset = ce.dataset AND kn.config = CASE WHEN ce.config = chosen THEN gb ELSE chosen END) THEN 0.5 ELSE 0 END AS rel
  FROM ce JOIN (SELECT q, count(*) AS n FROM rk GROUP BY 1) nn ON nn.q = ce.q LEFT JOIN rk ON rk.q = ce.q AND rk.config = ce.config LEFT JOIN nr ON nr.q = ce.q AND nr.dataset = ce.dataset),
ga AS (SELECT q, dataset, config, CAST(round(CAST(sim * imp * (1 + rel) AS DECIMAL(20, 9)), 6) AS DOUBLE) AS gain FROM im)""") + "SELECT q, dataset, config, gain, CAST(row_number() OVER (PARTITION BY q ORDER BY gain DESC, dataset, config) AS INTEGER) AS priority FROM ga WHERE gain >= 1e-6 QUALIFY row_number() OVER (PARTITION BY q ORDER BY gain DESC, dataset, config) <= 10")
def evidence_acquisition(s, d):
    """The gaps are made by the rule of ``known``."""
    m, k, n, r, b = _parts(s, d)
    return R.acquisition_plan(m, k, n, r, b)


CARD = """ne AS (SELECT mt.dataset AS q, mt.k, coalesce(c.n, 0) AS n FROM mt LEFT JOIN (SELECT q, count(*) AS n FROM nr GROUP BY 1) c ON c.q = mt.dataset),
sl AS (SELECT q, list(config ORDER BY rank) FILTER (WHERE rank <= 3) AS shortlist, list(config ORDER BY rank) AS ord, max(support) FILTER (WHERE rank = 1) AS support, max(confidence) FILTER (WHERE rank = 1) AS confidence FROM rk GROUP BY 1),
fr AS (SELECT a.dataset AS q, list(a.config) AS front FROM kn a WHERE NOT EXISTS (SELECT 1 FROM kn b WHERE b.dataset = a.dataset AND b.score >= a.score AND b.secs <= a.secs AND (b.score > a.score OR b.secs < a.secs)) GROUP BY 1),
dd AS (SELECT ne.q, ne.k, n, coalesce(shortlist, []) AS shortlist, coalesce(list_filter(ord, lambda c: list_contains(coalesce(front, []), c)), []) AS onf, front, support, confidence, gb, beats_global,
  CASE WHEN ne.k % 3 = 0 THEN 'pass' WHEN ne.k % 5 = 4 THEN 'fail' END AS validation FROM ne LEFT JOIN sl ON sl.q = ne.q LEFT JOIN ba ON ba.q = ne.q LEFT JOIN fr ON fr.q = ne.q),
ck AS (SELECT *, CASE WHEN k % 4 <> 3 AND n = 0 THEN 'fail' ELSE 'pass' END AS oracle_k_admissibility, 'pass' AS metric_contract, 'pass' AS task_compatibility, CASE WHEN len(shortlist) = 0 OR n = 0 THEN 'fail' WHEN support < 2 THEN 'warn' ELSE 'pass' END AS local_support,
  CASE WHEN confidence IS NULL THEN 'fail' WHEN confidence < 0.25 THEN 'warn' ELSE 'pass' END AS rank_support_heuristic, CASE WHEN beats_global THEN 'pass' WHEN NOT beats_global THEN 'fail' ELSE 'warn' END AS reference_neighbour_baseline_proxy,
  coalesce(validation, 'not_evaluated') AS heldout_validation, CASE WHEN front IS NULL THEN 'not_evaluated' WHEN len(onf) > 0 THEN 'pass' ELSE 'warn' END AS pareto_tradeoffs, CASE WHEN k % 2 = 0 THEN 'warn' ELSE 'not_evaluated' END AS spatial_information_audit,
  CASE WHEN list_contains(shortlist, 'Brand#11@sw0.8') THEN 'warn' ELSE 'pass' END AS failure_phenotypes FROM dd),
ac AS (SELECT *, CASE WHEN oracle_k_admissibility = 'fail' OR local_support = 'fail' THEN 'abstain' WHEN reference_neighbour_baseline_proxy = 'fail' OR heldout_validation = 'fail' THEN 'global_default'
  WHEN local_support = 'warn' OR rank_support_heuristic = 'warn' OR pareto_tradeoffs = 'warn' OR beats_global IS NULL OR heldout_validation <> 'pass' THEN 'evidence_required' ELSE 'personalised_set' END AS action FROM ck),
pr AS (SELECT *, CASE action WHEN 'global_default' THEN [gb] WHEN 'personalised_set' THEN CASE WHEN len(onf) > 0 THEN onf ELSE shortlist END ELSE [] END AS prim FROM ac)"""
CHECKS = ("oracle_k_admissibility", "metric_contract", "task_compatibility", "local_support", "rank_support_heuristic", "reference_neighbour_baseline_proxy", "heldout_validation", "pareto_tradeoffs", "spatial_information_audit", "failure_phenotypes")


@entry("decision_card", with_("perf", META, KNOWN, RANKED, BASE, CARD) + f"SELECT q, {', '.join(CHECKS)}, action, array_to_string(prim, ',') AS primary_set, array_to_string(list_filter(CASE WHEN action = 'personalised_set' THEN [gb] ELSE shortlist END, lambda c: NOT list_contains(prim, c)), ',') AS comparison_set FROM pr")
def decision_card(s, d):
    """Ten checks for every data set; validations, audits and severe failures are dealt by the data set's number."""
    m, k, n, r, b = _parts(s, d)
    number = F.substring("dataset", 8, 9).cast("int")
    points = k.select("dataset", "config", F.col("score").alias("accuracy"), F.col("secs").alias("speed"))
    fronts = E.pareto_frontier(points, {"accuracy": "max", "speed": "min"}, eps_rel=0.0, by="dataset").groupBy(F.col("dataset").alias("q")).agg(F.collect_list("config").alias("front"))
    evidence = m.select(F.col("dataset").alias("q"), F.when(number % 3 == 0, "pass").when(number % 5 == 4, "fail").alias("validation"), F.when(number % 2 == 0, "warn").alias("spatial"), F.array(F.lit("Brand#11@sw0.8")).alias("severe"))
    out = R.decision_card(m.withColumns({"metric": F.lit("ARI"), "higher_is_better": F.lit(True)}), n, r, b, fronts, evidence)
    return out.withColumns({c: F.array_join(c, ",") for c in ("primary_set", "comparison_set")})
