"""From evidence to a decision: which references may count, who ranks first on them, what to measure next, what to do.

All of it works on many requests at once. ``meta(dataset, vec, platform, task, truth, k_policy, oracle_k)`` describes data
sets, ``means(dataset, config, score)`` holds what is known. A request is a data set, too; it is never its own reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as N
from ..functions.scalars import clip, cosine

#: Lift of a reference of the same platform, and of the same task.
PLATFORM_PRIOR, TASK_PRIOR = 1.35, 1.5
#: Ground truths that a task may be judged by (fixed values).
TRUTHS = {
    "spatial_domain": ("spatial_domain",), "spatial_protein_domain": ("spatial_protein_domain",), "spatial_chromatin_domain": ("spatial_chromatin_domain",), "cell_type": ("cell_type", "cluster_proxy"),
    "svg": ("none", "cell_type"), "deconvolution": ("cell_type", "none"), "virtual_st": ("measured_expression", "none"),
}
#: Parts of a policy's name by the preference that they meet (fixed values).
POLICY_TOKENS = {
    "off": ("off", "sw0.0", "0.0", "expr", "expression"), "default": ("default", "sw0.3", "0.3", "mid"), "high": ("high", "sw0.8", "0.8", "strong", "spatial"),
    "sw0.0": ("off", "sw0.0", "0.0"), "sw0.3": ("default", "sw0.3", "0.3"), "sw0.8": ("high", "sw0.8", "0.8"),
}
PASS, WARN, FAIL, OPEN = "pass", "warn", "fail", "not_evaluated"


def truth_admissible(task: Column, truth: Column) -> Column:
    """Whether a task may be judged by a kind of ground truth; never by an unknown one."""
    allowed = F.lit(False)
    for name, kinds in TRUTHS.items():
        allowed = F.when(N.normalized_task(task) == name, F.lower(F.trim(truth)).isin(*kinds)).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def reasons_against(query: Column, reference: Column, truth: Column, k_policy: Column, oracle_k: Column) -> Column:
    """Why a reference may not count for a request, in strict mode; an empty array admits it."""
    policy = F.lower(F.trim(F.coalesce(k_policy, F.lit(""))))
    k = F.when(policy == "", "k_policy_missing").when(policy.isin(*N.ORACLE_K) | F.coalesce(oracle_k, F.lit(False)), "oracle_k_forbidden").when(~policy.isin(*N.HONEST_K), "k_policy_not_non_oracle")
    return F.array_compact(F.array(
        F.when(N.task_relation(query, reference) != "same", "task_mismatch"), F.when(~truth_admissible(query, truth), "ground_truth_incompatible_or_missing"), F.when(N.is_domain_task(query), k),
    ))


def audited(meta: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with every other data set: similarity, lifted where platform and task agree, and the reasons against.

    A request asks all references, so rows are requests times references; both are tables of data sets, not of observations.
    """
    q = requests.select(F.col("dataset").alias("q"), F.col("vec").alias("qv"), F.col("platform").alias("qp"), F.col("task").alias("qt"))
    pairs = meta.join(q, F.col("dataset") != F.col("q"))
    raw = clip((F.coalesce(cosine(F.col("vec"), F.col("qv")), F.lit(0.0)) + 1) / 2, 0, 1)
    against = reasons_against(F.col("qt"), F.col("task"), F.col("truth"), F.col("k_policy"), F.col("oracle_k"))
    same_platform = F.coalesce(N.platform(F.col("platform")) == N.platform(F.col("qp")), F.lit(False))
    out = pairs.select("q", "dataset", F.col("qt").alias("task"), raw.alias("raw"), against.alias("reasons"), same_platform.alias("same_platform"))
    lift = F.when(F.col("same_platform"), PLATFORM_PRIOR).otherwise(1.0) * TASK_PRIOR
    return out.withColumn("similarity", F.when(F.size("reasons") == 0, F.least(F.col("raw") * lift, F.lit(1.0))).otherwise(0.0))


def near_references(audit: DataFrame, k: int = 3) -> DataFrame:
    """``q, dataset, similarity, rank``: the k most similar admitted references; ties go to the later name."""
    order = Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 9)), F.desc("dataset"))
    kept = audit.filter(F.col("similarity") > 0).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return kept.select("q", "dataset", F.round("similarity", 4).alias("similarity"), "rank")


def best_configs(means: DataFrame) -> DataFrame:
    return means.groupBy("dataset").agg(F.min_by("config", F.struct(-F.round("score", 9), "config")).alias("best"))


def ranked_methods(near: DataFrame, means: DataFrame, prefer: str | None = None) -> DataFrame:
    """Every configuration with a score on a request's references: weighted mean, how far that is to be trusted, and rank.

    confidence is the mean weight times coverage times min(1, effective references / 2). A configuration whose policy
    meets the preference gains 0.02; a bare one 0.005 where a high spatial weight is preferred.
    """
    w, v = F.col("similarity"), F.col("score")
    j = near.join(means.select("dataset", "config", "score"), "dataset").join(best_configs(means), "dataset")
    total = near.groupBy("q").agg(F.sum("similarity").alias("total"))
    s = j.groupBy("q", "config").agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wv2"), F.avg(w).alias("mean_w"), F.count("*").alias("support"), F.count_if(F.col("best") == F.col("config")).alias("wins")).join(total, "q")
    score = F.col("wv") / F.col("w")
    n = F.col("w") * F.col("w") / F.greatest("w2", F.lit(1e-12))
    s = s.withColumn("score", score).withColumn("n", n).withColumn("variance", F.greatest(F.col("wv2") / F.col("w") - score * score, F.lit(0.0)))
    boost = F.lit(0.0)
    if prefer:
        tokens = (prefer.strip().lower(), *POLICY_TOKENS.get(prefer.strip().lower(), ()))
        policy = F.lower(N.policy_of(F.col("config")))
        met = F.lit(False)
        for t in tokens:
            met = met | policy.contains(t)
        boost = F.when(policy.isNotNull(), F.when(met, 0.02).otherwise(0.0)).otherwise(0.005 if "high" in tokens else 0.0)
    out = s.select(
        "q", "config", N.method_of(F.col("config")).alias("method"), F.round(F.col("score") + boost, 4).alias("score"), F.round(F.sqrt(F.col("variance") / F.greatest("n", F.lit(1.0))), 4).alias("uncertainty"),
        F.round(F.col("w") / F.greatest("total", F.lit(1e-12)), 4).alias("coverage"), "support", "wins",
        F.round(F.least(F.col("mean_w") * F.col("w") / F.greatest("total", F.lit(1e-12)) * F.least(F.lit(1.0), F.col("n") / 2), F.lit(1.0)), 4).alias("confidence"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "config")))


def global_bests(means: DataFrame, requests: DataFrame) -> DataFrame:
    """``q, global``: the configuration with the best mean over all data sets but the request's own."""
    sums = means.groupBy("config").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
    each = requests.select(F.col("dataset").alias("q")).join(sums)
    own = means.select(F.col("dataset").alias("q"), "config", F.col("score").alias("own"))
    left = each.join(own, ["q", "config"], "left").withColumn("c", F.col("c") - F.col("own").isNotNull().cast("int")).filter("c > 0")
    mean = F.round((F.col("s") - F.coalesce("own", F.lit(0.0))) / F.col("c"), 9)
    return left.groupBy("q").agg(F.min_by("config", F.struct(-mean, "config")).alias("global"))


def baseline(near: DataFrame, ranked: DataFrame, means: DataFrame, globals_: DataFrame) -> DataFrame:
    """Of each request's first choice: regret on its references against the best there and against the global best."""
    first = ranked.filter("rank = 1").select("q", F.col("config").alias("chosen"))
    scores = means.select("dataset", "config", "score")
    j = near.select("q", "dataset").join(scores, "dataset").join(first, "q").join(globals_, "q", "left")
    per = j.groupBy("q", "dataset").agg(F.first("chosen").alias("chosen"), F.first("global").alias("global"), F.max("score").alias("oracle"), F.max(F.when(F.col("config") == F.col("chosen"), F.col("score"))).alias("c"), F.max(F.when(F.col("config") == F.col("global"), F.col("score"))).alias("g"))
    out = per.groupBy("q").agg(F.first("chosen").alias("chosen"), F.first("global").alias("global"), F.avg("oracle").alias("o"), F.avg("c").alias("c"), F.avg("g").alias("g"))
    return out.select("q", "chosen", "global", F.round(F.col("o") - F.col("c"), 4).alias("regret_oracle"), F.round(F.col("g") - F.col("c"), 4).alias("regret_global"), (F.round(F.col("g") - F.col("c"), 9) < 0).alias("beats_global"))


def acquisition_plan(meta: DataFrame, means: DataFrame, near: DataFrame, ranked: DataFrame, base: DataFrame, top: int = 10, frontier: int = 5, least: float = 1e-6) -> DataFrame:
    """For each request the missing cells worth most: similarity x importance x (1 + relevance to the decision).

    Importance falls with a configuration's rank, grows with its uncertainty, and is 0.55 at least for the first ``frontier``
    and 0.75 for the global best. A cell of the first choice or of the global best is relevant, more so where the other one
    of the two is known.
    """
    configs = means.select("config").distinct()
    n = Window.partitionBy("q")
    rank = ranked.withColumn("n", F.count("*").over(n)).select("q", "config", "rank", (0.15 + 0.7 * (1 - (F.col("rank") - 1) / F.col("n")) + 0.25 * F.col("uncertainty")).alias("by_rank"))
    cells = base.select("q", "chosen", "global").join(meta.select("dataset"), F.col("dataset") != F.col("q")).join(configs)
    cells = cells.join(means.select("dataset", "config", F.lit(True).alias("known")), ["dataset", "config"], "left").filter("known is null").drop("known")
    cells = cells.join(rank, ["q", "config"], "left").join(near.select("q", "dataset", "similarity"), ["q", "dataset"], "left")
    other = F.when(F.col("config") == F.col("chosen"), F.col("global")).when(F.col("config") == F.col("global"), F.col("chosen"))
    cells = cells.withColumn("other", F.when(F.col("chosen") != F.col("global"), other)).join(means.select("dataset", F.col("config").alias("other"), F.lit(True).alias("other_known")), ["dataset", "other"], "left")
    is_global = F.coalesce(F.col("config") == F.col("global"), F.lit(False))
    in_front = (F.coalesce(F.col("rank"), F.lit(frontier + 1)) <= frontier) | is_global | (F.col("config") == F.col("chosen"))
    importance = F.greatest(F.lit(0.05), F.coalesce("by_rank", F.lit(0.0)), F.when(in_front, 0.55).otherwise(0.0), F.when(is_global, 0.75).otherwise(0.0))
    relevance = F.when((F.col("config") == F.col("chosen")) | is_global, 0.5).otherwise(0.0) + F.when(F.col("other_known"), 0.5).otherwise(0.0)
    gain = F.round(F.round(F.coalesce("similarity", F.lit(0.05)) * importance * (1 + relevance), 9), 6)
    best = cells.select("q", "dataset", "config", gain.alias("gain")).filter(F.col("gain") >= least)
    return best.withColumn("priority", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("gain"), "dataset", "config"))).filter(F.col("priority") <= top)


def shortlists(ranked: DataFrame, size: int = 3) -> DataFrame:
    """``q, shortlist, order, support, confidence``: names in order of rank, and what is known of the first."""
    names = lambda upto: F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= upto, F.struct("rank", "config")))), lambda x: x["config"])
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    return ranked.groupBy("q").agg(names(size).alias("shortlist"), names(1 << 30).alias("order"), first("support"), first("confidence"))


def decision_card(requests: DataFrame, near: DataFrame, ranked: DataFrame, base: DataFrame, fronts: DataFrame | None = None, evidence: DataFrame | None = None, min_support: int = 2, min_confidence: float = 0.25, size: int = 3) -> DataFrame:
    """For each request ten checks, the action they lead to, a primary set and a set to compare it with.

    requests: ``dataset, task, metric, higher_is_better``. fronts: ``q, front`` (configurations of a matched Pareto front).
    evidence: ``q, validation, spatial, severe`` - the status of a held-out validation and of the spatial audit, and
    configurations with severe failure modes. What is not given is not evaluated. The first that applies: abstain
    (admissible evidence is absent), global_default (the ranking lost to the global best or failed its validation),
    evidence_required (support, confidence, trade-offs or validation fall short), personalised_set.
    """
    d = requests.select(F.col("dataset").alias("q"), "task", "metric", "higher_is_better").join(near.groupBy("q").agg(F.count("*").alias("n")), "q", "left").join(shortlists(ranked, size), "q", "left").join(base.select("q", "global", "beats_global"), "q", "left")
    d = d.join(fronts, "q", "left") if fronts is not None else d.withColumn("front", F.lit(None).cast("array<string>"))
    d = d.join(evidence, "q", "left") if evidence is not None else d.withColumns({"validation": F.lit(None).cast("string"), "spatial": F.lit(None).cast("string"), "severe": F.lit(None).cast("array<string>")})
    none = F.array().cast("array<string>")
    d = d.withColumns({"shortlist": F.coalesce("shortlist", none), "on_front": F.filter(F.coalesce("order", none), lambda c: F.array_contains(F.coalesce("front", none), c)), "n": F.coalesce("n", F.lit(0))})
    checks = {
        "oracle_k_admissibility": F.when(N.is_domain_task(F.col("task")) & (F.col("n") == 0), FAIL).otherwise(PASS),
        "metric_contract": F.when((F.coalesce(F.trim("metric"), F.lit("")) == "") | F.col("higher_is_better").isNull(), FAIL).otherwise(PASS),
        "task_compatibility": F.lit(PASS),
        "local_support": F.when((F.size("shortlist") == 0) | (F.col("n") == 0), FAIL).when(F.col("support") < min_support, WARN).otherwise(PASS),
        "rank_support_heuristic": F.when(F.col("confidence").isNull(), FAIL).when(F.col("confidence") < min_confidence, WARN).otherwise(PASS),
        "reference_neighbour_baseline_proxy": F.when(F.col("beats_global"), PASS).when(~F.col("beats_global"), FAIL).otherwise(WARN),
        "heldout_validation": F.coalesce("validation", F.lit(OPEN)),
        "pareto_tradeoffs": F.when(F.col("front").isNull(), OPEN).when(F.size("on_front") > 0, PASS).otherwise(WARN),
        "spatial_information_audit": F.coalesce("spatial", F.lit(OPEN)),
        "failure_phenotypes": F.when(F.col("severe").isNull(), OPEN).when(F.arrays_overlap("severe", "shortlist"), WARN).otherwise(PASS),
    }
    d = d.withColumns(checks)
    failed = lambda *c: F.greatest(*[(F.col(x) == FAIL).cast("int") for x in c]) == 1
    warned = lambda *c: F.greatest(*[(F.col(x) == WARN).cast("int") for x in c]) == 1
    short = warned("task_compatibility", "local_support", "rank_support_heuristic") | (F.col("front").isNotNull() & (F.col("pareto_tradeoffs") != PASS)) | F.col("beats_global").isNull() | (F.col("heldout_validation") != PASS)
    action = F.when(failed("task_compatibility", "oracle_k_admissibility", "metric_contract", "local_support"), "abstain").when(failed("reference_neighbour_baseline_proxy", "heldout_validation"), "global_default").when(short, "evidence_required").otherwise("personalised_set")
    d = d.withColumn("action", action)
    default = F.array_compact(F.array("global"))
    primary = F.when(F.col("action") == "global_default", default).when(F.col("action") == "personalised_set", F.when(F.size("on_front") > 0, F.col("on_front")).otherwise(F.col("shortlist"))).otherwise(none)
    d = d.withColumn("primary_set", primary)
    compared = F.when(F.col("action") == "personalised_set", F.array_except(default, "primary_set")).otherwise(F.array_except("shortlist", "primary_set"))
    return d.select("q", *checks, "action", "primary_set", compared.alias("comparison_set"))
