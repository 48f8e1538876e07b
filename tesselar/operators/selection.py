"""Which configuration to deploy: ranks under resampling, a selector frozen before its test, policies on held-out units.

Units (data sets, donors, studies) are resampled by Poisson weights drawn from hashes, so all replicates are one pass: a
unit's row meets every draw, and what is added up is partially aggregated where the rows lie. Draws repeat whatever the
partitions. ``scores(unit, config, score)`` has one row for a unit and a configuration.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip

#: P(X <= k) of a Poisson variable of mean 1, as far as a 32-bit draw can tell.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))
#: Features of a selector: its Gram matrix is solved on the driver.
MOST_FEATURES = 500


def weight(draw: str, unit: str) -> Column:
    """How often a draw takes a unit: a Poisson variable of mean 1 from the hash of both."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", draw, unit)), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


def drawn(df: DataFrame, draws: int, unit: str = "unit") -> DataFrame:
    """Every row with every draw that takes its unit, and how often."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight("draw", unit)).filter("w > 0")


def drawn_ranks(scores: DataFrame, draws: int, higher_is_better: bool = True) -> DataFrame:
    """(draw, config, rank) by the mean over the draw's units, ties averaged; a configuration without score there is last."""
    per = drawn(scores.filter("score is not null"), draws).groupBy("draw", "config").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("mean"))
    every = scores.select("config").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    per = every.join(per, ["draw", "config"], "left").withColumn("mean", F.round("mean", 9))
    w = Window.partitionBy("draw")
    key = F.col("mean").desc_nulls_last() if higher_is_better else F.col("mean").asc_nulls_last()
    tied = (F.count("*").over(Window.partitionBy("draw", "mean")) - 1) / 2.0
    return per.withColumn("rank", F.when(F.col("mean").isNull(), F.count("*").over(w).cast("double")).otherwise(F.rank().over(w.orderBy(key)) + tied)).select("draw", "config", "rank")


def rank_stability(scores: DataFrame, draws: int = 200, higher_is_better: bool = True, level: float = 0.95) -> DataFrame:
    """``config, mean_score, mean_rank, rank_ci_low, rank_ci_high, p_best, rank_stability`` over resampled units."""
    ranks, n = drawn_ranks(scores, draws, higher_is_better), scores.agg(F.count_distinct("config").alias("m"))
    at = lambda q: F.percentile("rank", q)
    s = ranks.groupBy("config").agg(
        F.avg("rank").alias("mean_rank"), at((1 - level) / 2).alias("rank_ci_low"), at((1 + level) / 2).alias("rank_ci_high"), (at(0.75) - at(0.25)).alias("_iqr"), F.count_if(F.rint("rank") == 1).alias("_first")
    )
    s = s.join(scores.groupBy("config").agg(F.avg("score").alias("mean_score")), "config").crossJoin(F.broadcast(n))
    return s.select("config", "mean_score", "mean_rank", "rank_ci_low", "rank_ci_high", ((F.col("_first") + 1.0) / (draws + F.col("m"))).alias("p_best"), clip(1 - F.col("_iqr") / F.greatest(F.col("m") - 1, F.lit(1)), 0, 1).alias("rank_stability"))


def rank_posterior(scores: DataFrame, draws: int = 200, higher_is_better: bool = True) -> DataFrame:
    """``config, rank, mass``: share of each rank among the draws under a uniform Dirichlet prior, zeros included."""
    seen = drawn_ranks(scores, draws, higher_is_better).groupBy("config", F.rint("rank").cast("int").alias("rank")).agg(F.count("*").alias("n"))
    configs = scores.select("config").distinct()
    m = configs.agg(F.count("*").alias("m"))
    grid = configs.crossJoin(F.broadcast(m)).withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return grid.join(seen, ["config", "rank"], "left").select("config", "rank", ((F.coalesce("n", F.lit(0)) + 1.0) / (draws + F.col("m"))).alias("mass"))


def resampled(df: DataFrame, value: str, by: list[str], draws: int, level: float = 0.95) -> DataFrame:
    """For each group ``n, mean, ci_low, ci_high, p_le_0`` of a value's mean over units, intervals from resampling them."""
    some = df.filter(F.col(value).isNotNull())
    per = drawn(some, draws).groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("_m"))
    q = per.groupBy(*by).agg(F.percentile("_m", (1 - level) / 2).alias("ci_low"), F.percentile("_m", (1 + level) / 2).alias("ci_high"), F.avg(F.when(F.round("_m", 12) <= 0, 1.0).otherwise(0.0)).alias("p_le_0"))
    return some.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(q, by, "left")


# --- the selector: ridge regression on development units, one gate on calibration units, actions on test units


def complete(scores: DataFrame) -> DataFrame:
    """The units that have a score of every configuration; a selector is fitted on whole rows."""
    n = scores.agg(F.count_distinct("config").alias("_all"))
    whole = scores.filter("score is not null").groupBy("unit").agg(F.count_distinct("config").alias("_n")).crossJoin(F.broadcast(n)).filter("_n = _all")
    return scores.join(whole.select("unit"), "unit", "left_semi")


def predicted(units: DataFrame, scores: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``unit, fold, config, score, predicted``: every configuration's score by a ridge regression on the units' features,
    fitted on those with fold ``development`` alone.

    ``units``: (unit, fold, vec). Features are standardised by the development units, the intercept is not shrunk. All
    configurations share one Gram matrix, so sums of products are one aggregation for all of them; the matrix has the
    features squared as entries and is inverted on the driver, the rest stays in tables.
    """
    held = complete(scores)
    units = units.join(held.select("unit").distinct(), "unit", "left_semi")
    x = units.select("unit", "fold", F.posexplode("vec").alias("g", "v"))
    moments = x.filter("fold = 'development'").groupBy("g").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = x.join(F.broadcast(moments), "g").select("unit", "fold", "g", ((F.col("v") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("z"))
    dev = z.filter("fold = 'development'").select("unit", "g", "z")
    gram = dev.join(dev.withColumnsRenamed({"g": "h", "z": "zh"}), "unit").groupBy("g", "h").agg(F.sum(F.col("z") * F.col("zh")).alias("s"))
    p = x.agg(F.coalesce(F.max("g"), F.lit(-1))).first()[0] + 1
    if p > MOST_FEATURES:
        raise ValueError(f"{p} features; at most {MOST_FEATURES}")
    a = np.eye(p) * alpha
    for r in gram.collect():  # p times p numbers
        a[r["g"], r["h"]] += r["s"]
    inverse = np.linalg.inv(a)
    rows = [(i, j, float(inverse[i, j])) for i in range(p) for j in range(p)]
    inv = F.broadcast(units.sparkSession.createDataFrame(rows, "g int, h int, a double"))
    y = held.join(units.select("unit", "fold"), "unit")
    means = y.filter("fold = 'development'").groupBy("config").agg(F.avg("score").alias("base"))
    b = dev.join(y.select("unit", "config", "score"), "unit").groupBy("config", "g").agg(F.sum(F.col("z") * F.col("score")).alias("b"))
    beta = b.join(inv, "g").groupBy("config", "h").agg(F.sum(F.col("a") * F.col("b")).alias("beta")).withColumnRenamed("h", "g")
    fit = z.join(beta, "g").groupBy("unit", "config").agg(F.sum(F.col("z") * F.col("beta")).alias("f"))
    return y.join(means, "config").join(fit, ["unit", "config"], "left").select("unit", "fold", "config", "score", (F.col("base") + F.coalesce("f", F.lit(0.0))).alias("predicted"))


def choices(scored: DataFrame) -> DataFrame:
    """For each unit the configuration of the best predicted score, the global one, the predicted gain and what both score."""
    total = scored.filter("fold = 'development'").groupBy("config").agg(F.round(F.avg("score"), 9).alias("m"))
    best = total.agg(F.max("m").alias("m"))
    global_ = total.join(F.broadcast(best), "m").agg(F.min("config").alias("global"))
    d = scored.crossJoin(F.broadcast(global_)).withColumn("p", F.round("predicted", 9))
    top = Window.partitionBy("unit").orderBy(F.desc("p"), "config")
    picked = d.withColumn("n", F.row_number().over(top)).groupBy("unit", "fold", "global").agg(
        F.max(F.when(F.col("n") == 1, F.col("config"))).alias("selected"), F.max("score").alias("best"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("config") == F.col("global"), F.col("score"))).alias("global_score"),
        (F.max("p") - F.max(F.when(F.col("config") == F.col("global"), F.col("p")))).alias("gain"),
    )
    return picked


def calibrated(chosen: DataFrame, thresholds: list[float], minimum_coverage: float = 0.2, margin: float = 0.02, draws: int = 200) -> DataFrame:
    """``threshold, coverage, mean_regret_difference, ci_low, ci_high, eligible, frozen`` on the calibration units.

    A threshold is eligible if it covers enough units, loses nothing on average and its interval stays below the margin;
    the eligible one of the greatest coverage, then least regret, then greatest threshold is the policy's.
    """
    t = chosen.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    d = chosen.filter("fold = 'calibration'").crossJoin(F.broadcast(t))
    covered = (F.col("selected") != F.col("global")) & (F.col("gain") >= F.col("threshold"))
    d = d.select("unit", "threshold", covered.alias("covered"), F.when(covered, F.col("global_score") - F.col("score")).otherwise(0.0).alias("delta"))
    share = d.groupBy("threshold").agg(F.avg(F.col("covered").cast("double")).alias("coverage"))
    s = resampled(d, "delta", ["threshold"], draws).join(share, "threshold").withColumnRenamed("mean", "mean_regret_difference")
    ok = (F.col("coverage") >= minimum_coverage) & (F.round("mean_regret_difference", 12) <= 0) & (F.col("ci_high") <= margin)
    s = s.withColumn("eligible", F.coalesce(ok, F.lit(False)))
    order = Window.partitionBy("eligible").orderBy(F.desc("coverage"), F.round("mean_regret_difference", 12), F.desc("threshold"))  # as many rows as thresholds
    return s.withColumn("frozen", F.col("eligible") & (F.row_number().over(order) == 1)).select("threshold", "coverage", "mean_regret_difference", "ci_low", "ci_high", "eligible", "frozen")


def actions(chosen: DataFrame, policy: DataFrame) -> DataFrame:
    """``unit, selected_config, action, predicted_gain, threshold`` of the test units, by the frozen threshold alone; without one
    every unit requires evidence. Test scores are not read."""
    frozen = policy.filter("frozen").agg(F.max("threshold").alias("threshold"))
    d = chosen.filter("fold = 'test'").select("unit", "selected", "global", "gain").crossJoin(F.broadcast(frozen))
    personal = (F.col("selected") != F.col("global")) & (F.col("gain") >= F.col("threshold"))
    none = F.col("threshold").isNull()
    return d.select(
        "unit", F.when(none, None).when(personal, F.col("selected")).otherwise(F.col("global")).alias("selected_config"), F.when(none, "evidence_required").when(personal, "personalised_set").otherwise("global_default").alias("action"),
        F.when(~none, F.col("gain")).alias("predicted_gain"), "threshold",
    )


def evaluated(acts: DataFrame, scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: what the frozen actions cost on the test units; no contrast where an action names no configuration."""
    y = scored.select("unit", F.col("config").alias("selected_config"), "score")
    d = acts.join(chosen.select("unit", "best", "global", "global_score"), "unit").join(y, ["unit", "selected_config"], "left")
    missing = F.count_if(F.col("score").isNull()) > 0
    scored_only = lambda c: F.when(~missing, F.avg(c))
    return d.agg(
        F.when(missing, "evidence_required").otherwise("scored").alias("status"), F.count("*").alias("n_units"), F.when(missing, 0.0).otherwise(F.avg((F.col("selected_config") != F.col("global")).cast("double"))).alias("coverage"),
        scored_only(F.col("best") - F.col("score")).alias("mean_deployed_regret"), scored_only(F.col("best") - F.col("global_score")).alias("mean_global_regret"), scored_only(F.col("global_score") - F.col("score")).alias("mean_regret_difference"),
    )


# --- policies on held-out units


def by_unit(means: DataFrame, units: DataFrame) -> DataFrame:
    """Means over the data sets of each unit, unweighted: (unit, config, score) from (dataset, config, score)."""
    return means.join(units.select("dataset", "unit"), "dataset").groupBy("unit", "config").agg(F.avg("score").alias("score"))


def held_out_policies(scores: DataFrame, ranked: DataFrame, min_training: int = 4, confidence_floor: float = 0.2, advantage: float = 0.02) -> DataFrame:
    """For each unit the regret of four policies that do not know it: the others' best configuration, the first of the
    neighbours' ranking, the same behind a gate, and a configuration at random.

    ``ranked``: (q, config, score, confidence, rank), each unit's recommendation without its own scores. The gate takes the
    neighbours' choice if its confidence reaches the floor and its score exceeds the global best's mean by ``advantage``.
    Training means of all units are sums less the own part, so nothing is fitted once for each unit.
    """
    some = scores.filter("score is not null")
    total = some.groupBy("config").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    held = some.groupBy("unit").agg(F.max("score").alias("oracle"), F.avg("score").alias("random"))
    n_units = scores.agg((F.count_distinct("unit") - 1).alias("training"))
    cells = held.select("unit").crossJoin(F.broadcast(total)).join(some, ["unit", "config"], "left")
    rest = F.col("n") - F.when(F.col("score").isNull(), 0).otherwise(1)
    train = cells.withColumn("train", F.when(rest > 0, F.round((F.col("s") - F.coalesce("score", F.lit(0.0))) / rest, 9))).filter("train is not null")
    g = train.groupBy("unit").agg(F.max_by(F.struct("config", "score", "train"), F.struct("train", "config")).alias("g"))
    first = ranked.filter("rank = 1").select(F.col("q").alias("unit"), F.col("config").alias("knn"), F.col("score").alias("proxy"), "confidence")
    own = some.select("unit", F.col("config").alias("knn"), F.col("score").alias("knn_score"))
    d = held.crossJoin(F.broadcast(n_units)).filter(F.col("training") >= min_training).join(g, "unit").join(first, "unit", "left").join(own, ["unit", "knn"], "left")
    beats = F.coalesce(F.round(F.col("proxy") - F.col("g.train") - advantage, 9) >= 0, F.lit(False))
    gate = beats & F.coalesce(F.col("confidence") >= confidence_floor, F.lit(False))
    return d.select(
        "unit", "oracle", F.col("g.config").alias("global_method"), (F.col("oracle") - F.col("g.score")).alias("global_regret"), F.col("knn").alias("knn_method"), (F.col("oracle") - F.col("knn_score")).alias("knn_regret"),
        F.coalesce("confidence", F.lit(0.0)).alias("knn_confidence"), beats.alias("knn_beats_global_proxy"), F.when(gate, F.col("knn")).otherwise(F.col("g.config")).alias("gated_method"),
        (F.col("oracle") - F.when(gate, F.col("knn_score")).otherwise(F.col("g.score"))).alias("gated_regret"), F.when(gate, "personalised").otherwise("global_default").alias("gated_action"), (F.col("oracle") - F.col("random")).alias("random_regret"),
    )


def policy_summary(policies: DataFrame, margin: float = 0.02, draws: int = 200) -> DataFrame:
    """For the neighbours' and the gated policy: mean regret and its paired difference to the global best's with an interval over
    resampled units, and whether it is no worse than the margin on average, by its interval, and better."""
    one = lambda c: policies.select("unit", F.lit(c).alias("policy"), F.col(f"{c}_regret").alias("regret"), "global_regret", (F.lit(c) == "knn").alias("_all"), "gated_action")
    d = one("knn").unionByName(one("gated")).withColumn("delta", F.col("regret") - F.col("global_regret"))
    m = d.groupBy("policy").agg(F.avg("regret").alias("mean_regret"), F.avg("global_regret").alias("mean_global_regret"), F.avg(F.when(F.col("_all") | (F.col("gated_action") == "personalised"), 1.0).otherwise(0.0)).alias("personalised_rate"))
    r = resampled(d, "delta", ["policy"], draws).withColumnsRenamed({"mean": "mean_delta", "p_le_0": "prob_delta_le_0"})
    better = F.round(F.col("mean_regret") - F.col("mean_global_regret"), 9)
    return m.join(r, "policy").select(
        "policy", "n", "mean_regret", "mean_global_regret", "mean_delta", "ci_low", "ci_high", "prob_delta_le_0", "personalised_rate", (better <= margin).alias("noninferior"), (F.round("ci_high", 9) <= margin).alias("statistical_noninferior"), (better < 0).alias("superior")
    )


def policies_by_class(policies: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean regrets and share of personalised units for each class of units; a unit without one counts as unknown."""
    d = policies.join(classes, "unit", "left").withColumn("class", F.coalesce("class", F.lit("unknown")))
    return d.groupBy("class").agg(F.count("*").alias("n"), *[F.avg(f"{p}_regret").alias(f"mean_{p}_regret") for p in ("global", "knn", "gated")], F.avg((F.col("gated_action") == "personalised").cast("double")).alias("personalised_rate"))


def regret_intervals(policies: DataFrame, draws: int = 200) -> DataFrame:
    """``policy, n, mean, ci_low, ci_high, std`` of each policy's regret over resampled units."""
    long = policies.select("unit", F.expr("stack(3, 'global', global_regret, 'knn', knn_regret, 'gated', gated_regret) as (policy, regret)"))
    sd = long.groupBy("policy").agg(F.coalesce(F.stddev_samp("regret"), F.lit(0.0)).alias("std"))
    return resampled(long, "regret", ["policy"], draws).join(sd, "policy").select("policy", "n", "mean", "ci_low", "ci_high", "std")


def rank_concordance(scores: DataFrame) -> DataFrame:
    """``n_units, n_methods, kendall_w`` of the units' orders of configurations; what a unit lacks is last, and units with fewer
    than two scores take no part. Null where fewer than two are left."""
    some = scores.filter("score is not null")
    order = Window.partitionBy("unit").orderBy(F.desc(F.round("score", 9)), "config")
    ranks = some.select("unit", "config", F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy("unit")).alias("k")).filter("k > 1")
    n = ranks.agg(F.count_distinct("unit").alias("n_units"))
    m = scores.agg(F.count_distinct("config").alias("n_methods"))
    sums = scores.select("config").distinct().join(ranks.groupBy("config").agg(F.sum("rank").alias("s"), F.count("*").alias("have")), "config", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(m))
    total = sums.withColumn("s", F.coalesce("s", F.lit(0)) + (F.col("n_units") - F.coalesce("have", F.lit(0))) * F.col("n_methods"))
    u, k = F.first("n_units").cast("double"), F.first("n_methods").cast("double")
    w = 12.0 * F.var_pop("s") * k / (u * u * (k * k * k - k))
    return total.agg(F.first("n_units").alias("n_units"), F.first("n_methods").alias("n_methods"), F.when((u > 1) & (k > 1), w).alias("kendall_w"))
