"""Benchmark evidence: ``perf(dataset, config, seed, score, secs, status)`` and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio
from ..plans.tables import saved
from .relational import range_ranks

#: Statuses that mean a run gave no result (fixed values); readers of objectives leave out skipped runs as well.
FAILED = ("failed", "error", "timeout", "oom")
FAILED_OR_SKIPPED = (*FAILED, "skipped")


def usable(perf: DataFrame, statuses: tuple[str, ...] = FAILED) -> DataFrame:
    """Rows with a finite score whose status is not among ``statuses``."""
    s = F.lower(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    return perf.filter(~s.isin(*statuses) & F.col("score").isNotNull() & ~F.isnan("score"))


def mean_scores(perf: DataFrame) -> DataFrame:
    return perf.groupBy("dataset", "config").agg(F.avg("score").alias("score"), F.avg("secs").alias("secs"), F.count("*").alias("n"))


def mean_std(perf: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one run) and number of runs."""
    return perf.groupBy("dataset", "config").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def global_best(means: DataFrame) -> DataFrame:
    """The configuration with the best mean over data sets; the first in order wins ties."""
    m = means.groupBy("config").agg(F.avg("score").alias("mean"), F.count("*").alias("datasets"))
    return m.orderBy(F.desc(F.round("mean", 9)), "config").limit(1)


def niches(means: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Where a configuration reaches ``threshold`` of the data set's best."""
    best = F.max("score").over(Window.partitionBy("dataset"))
    return means.withColumn("best", best).filter(F.col("score") >= threshold * F.col("best")).select("dataset", "config", "score", "best")


def leave_one_out(means: DataFrame) -> DataFrame:
    """For each data set, the configuration best elsewhere, its score here and its regret."""
    all_ = Window.partitionBy("config")
    train = means.withColumn("train", (F.sum("score").over(all_) - F.col("score")) / (F.count("*").over(all_) - 1)).filter(F.col("train").isNotNull())
    here = Window.partitionBy("dataset")
    picked = train.withColumn("oracle", F.max("score").over(here)).withColumn("rank", F.row_number().over(here.orderBy(F.desc(F.round("train", 9)), "config"))).filter("rank = 1")
    return picked.select("dataset", "config", "score", "oracle", (F.col("oracle") - F.col("score")).alias("regret"))


def average_rank(df: DataFrame, value: str, by: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """Ranks from 1 with ties averaged; a null takes the last rank."""
    w = Window.partitionBy(by)
    key = -F.col(value) if descending else F.col(value)
    r = F.rank().over(w.orderBy(key.asc_nulls_last())) + (F.count("*").over(Window.partitionBy(by, value)) - 1) / 2.0
    return df.withColumn(name, F.when(F.col(value).isNull(), F.count("*").over(w).cast("double")).otherwise(r))


def step_up(df: DataFrame, p: str, q: str, key: str, how: str = "bh") -> DataFrame:
    """Adjusted p values. bh, by: reverse cumulative minimum; holm: cumulative maximum; bonferroni. Null p takes no part.

    Tests are ranked by ranges dealt to many tasks (``relational.range_ranks``); an extreme runs within a range and meets
    that of the ranges beyond it, of which there is one row each. Frames grow by a row at a time, so a family costs a sort.
    """
    some = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    if how not in ("bh", "by", "holm"):
        n = some.agg(F.count("*").alias("_m"))
        return some.crossJoin(F.broadcast(n)).withColumn(q, clip(F.col(p) * F.col("_m"), 0, 1)).drop("_m")
    d = range_ranks(some, [], p, key, "_r", keep=True)
    m = d.count()
    r = F.col("_r")
    if how == "holm":
        each, extreme, order, beyond = F.col(p) * (m - r + 1), F.max, F.asc, (Window.unboundedPreceding, -1)
    else:
        # Partial sums of 1 / i on many tasks, so that no row holds a list as long as the family.
        more = df.sparkSession.range(1, m + 1).agg(F.sum(1.0 / F.col("id"))).first()[0] if how == "by" and m else None
        each, extreme, order, beyond = F.col(p) * m * (1.0 if more is None else more) / r, F.min, F.desc, (1, Window.unboundedFollowing)
    d = d.withColumn("_e", each)
    ends = d.groupBy("_p").agg(extreme("_e").alias("_e"))
    # One row for each range; the frame that looks ahead is quadratic in their number alone.
    past = F.broadcast(ends.select("_p", extreme("_e").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(*beyond)).alias("_past")))
    here = extreme("_e").over(Window.partitionBy("_p").orderBy(order("_r")).rowsBetween(Window.unboundedPreceding, 0))
    met = F.least if extreme is F.min else F.greatest
    return d.withColumn("_here", here).join(past, "_p").withColumn(q, clip(met("_here", "_past"), 0, 1)).drop("_p", "_r", "_e", "_here", "_past")


def pareto_frontier(points: DataFrame, directions: dict[str, str], eps_rel: float = 1e-3, by: str | None = None) -> DataFrame:
    """Configurations that no other dominates: nowhere worse beyond a share of the axis's span, somewhere better beyond it.

    Only axes that both have are compared. Candidates of one ``by`` meet in an anti-join; a front is taken over summaries,
    so the rows are configurations, not runs.
    """
    axes = list(directions)
    w = Window.partitionBy(by) if by else Window.partitionBy()
    sign = {a: 1.0 if d == "max" else -1.0 for a, d in directions.items()}
    spans = points.select(*([by] if by else []), "config", *[(F.col(a) * sign[a]).alias(a) for a in axes], *[((F.max(a).over(w) - F.min(a).over(w)) * eps_rel).alias(f"_e{a}") for a in axes])
    l, r = spans.alias("l"), spans.alias("r")  # r dominates l
    shared = lambda a: F.col(f"l.{a}").isNotNull() & F.col(f"r.{a}").isNotNull()
    worse = lambda a: shared(a) & (F.col(f"r.{a}") < F.col(f"l.{a}") - F.col(f"l._e{a}"))
    better = lambda a: shared(a) & (F.col(f"r.{a}") > F.col(f"l.{a}") + F.col(f"l._e{a}"))
    no_worse, some_better = F.lit(True), F.lit(False)
    for a in axes:
        no_worse, some_better = no_worse & ~worse(a), some_better | better(a)
    cond = no_worse & some_better & (F.col("l.config") != F.col("r.config"))
    if by:
        cond = (F.col(f"l.{by}") == F.col(f"r.{by}")) & cond
    kept = l.join(r, cond, "left_anti")
    return points.join(kept.select(*([by] if by else []), "config"), [*([by] if by else []), "config"], "left_semi")


def nondominated_layers(points: DataFrame, directions: dict[str, str], eps_rel: float = 1e-3) -> DataFrame:
    """``config, layer``: fronts peeled one after another."""
    rest, layer, out = saved(points, "layer"), 0, None
    while not rest.isEmpty():
        front = saved(pareto_frontier(rest, directions, eps_rel).select("config").withColumn("layer", F.lit(layer)), "front")
        if front.isEmpty():  # a cycle under eps: the rest is one layer
            front = rest.select("config").withColumn("layer", F.lit(layer))
        out = front if out is None else out.unionByName(front)
        rest = saved(rest.join(front, "config", "left_anti"), "layer")
        layer += 1
    return out


def knee_point(front: DataFrame, directions: dict[str, str]) -> DataFrame:
    """The member nearest to the ideal: least root mean square of the normalised distances; constant axes count 0.5."""
    w = Window.partitionBy()
    parts = []
    for a, d in directions.items():
        lo, hi = F.min(a).over(w), F.max(a).over(w)
        u = F.when(hi > lo, (F.col(a) - lo) / (hi - lo)).otherwise(0.5)
        parts.append(F.when(hi > lo, 1 - u if d == "max" else u).otherwise(0.5))
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return front.withColumn("distance", F.sqrt(total / len(parts))).orderBy(F.round("distance", 9), "config").limit(1)


def selective_regret(choices: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``choices(dataset, confidence, personal, fallback)``: coverage and mean regret if personal picks need a confidence."""
    d = choices.crossJoin(F.broadcast(thresholds))
    use = F.col("confidence") >= F.col("threshold")
    return d.groupBy("threshold").agg(F.avg(F.when(use, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.when(use, F.col("personal")).otherwise(F.col("fallback"))).alias("regret"))


def kendalls_w(ranks: DataFrame) -> DataFrame:
    """Agreement of data sets on the configurations' ranks (``dataset, config, rank``)."""
    sums = ranks.groupBy("config").agg(F.sum("rank").alias("s"), F.count("*").alias("m"))
    return sums.agg((12.0 * F.var_pop("s") * F.count("*") / (F.max("m") * F.max("m") * (F.pow(F.count("*").cast("double"), F.lit(3.0)) - F.count("*")))).alias("w"))


def paired_differences(means: DataFrame) -> DataFrame:
    """Upper triangle of configuration pairs over shared data sets."""
    a = means.select("dataset", F.col("config").alias("a"), F.col("score").alias("sa"))
    b = means.select("dataset", F.col("config").alias("b"), F.col("score").alias("sb"))
    d = F.col("sa") - F.col("sb")
    return a.join(b, "dataset").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.avg(F.when(F.round(d, 9) > 0, 1.0).otherwise(0.0)).alias("wins"))


def sign_flip_p(diffs: DataFrame, flips: int = 64) -> DataFrame:
    """``a, b, p``: share of hash-drawn sign flips at least as extreme, (count + 1) / (flips + 1); ``diffs(a, b, dataset, d)``."""
    f = diffs.withColumn("flip", F.explode(F.sequence(F.lit(1), F.lit(flips))))
    sign = F.when(F.substring(F.md5(F.concat_ws(":", "flip", "dataset")), 1, 1) < "8", 1.0).otherwise(-1.0)
    per = f.groupBy("a", "b", "flip").agg(F.abs(F.avg(sign * F.col("d"))).alias("m"), F.abs(F.avg("d")).alias("o"))
    return per.groupBy("a", "b").agg(((F.sum(F.when(F.col("m") >= F.col("o") - 1e-12, 1).otherwise(0)) + 1.0) / (flips + 1)).alias("p"))


def bootstrap_means(means: DataFrame, draws: int = 32) -> DataFrame:
    """``config, lo, hi``: interval of the mean over data sets when each is drawn 0 to 3 times by the hash of (draw, data set)."""
    d = means.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    times = F.ascii(F.substring(F.md5(F.concat_ws(":", "b", "dataset")), 1, 1)) % 4
    per = d.groupBy("config", "b").agg(ratio(F.sum(times * F.col("score")), F.sum(times).cast("double")).alias("m"))
    return per.groupBy("config").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def latest(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key: by time, later lines winning ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ingested_at"), F.desc("line_no"))
    return evidence.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def consensus(evidence: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row per (dataset, method): laboratory means, their median, spread and whether they agree.

    Verified: at least two laboratories, two of them within ``tolerance`` of the median; disputed: at least two, but not so.
    """
    labs = evidence.groupBy("dataset", "method", "node").agg(F.avg("score").alias("lab"), F.count("*").alias("n"), F.collect_set("seed").alias("seeds"))
    mid = labs.groupBy("dataset", "method").agg(F.median("lab").alias("consensus"))
    both = labs.join(mid, ["dataset", "method"]).withColumn("dev", F.abs(F.col("lab") - F.col("consensus")))
    near = F.round("dev", 9) <= tolerance
    out = both.groupBy("dataset", "method").agg(
        F.first("consensus").alias("consensus"), F.count("*").alias("n_labs"), F.sum("n").alias("n_records"), F.avg("lab").alias("mean"), F.median("dev").alias("mad"),
        (F.max("lab") - F.min("lab")).alias("spread"), F.avg(F.when(near, 1.0).otherwise(0.0)).alias("reproducibility"), F.count_if(near).alias("near"),
    )
    return out.withColumn("status", F.when(F.col("n_labs") < 2, "unverified").when(F.col("near") >= 2, "verified").otherwise("disputed")).drop("near")


def track_records(evidence: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per laboratory: cells it contributed to, in how many its mean agrees with the consensus, and how many are disputed."""
    labs = evidence.groupBy("dataset", "method", "node").agg(F.avg("score").alias("lab"))
    c = consensus(evidence, tolerance).select("dataset", "method", "consensus", "status")
    j = labs.join(c, ["dataset", "method"])
    ok = (F.col("status") == "verified") & (F.round(F.abs(F.col("lab") - F.col("consensus")), 9) <= tolerance)
    return j.groupBy("node").agg(F.count("*").alias("cells"), F.count_if(ok).alias("reproduced"), F.count_if(F.col("status") == "disputed").alias("disputed"))


def new_records(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the store lacks, once each: the append of an idempotent log."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    first = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.join(store.select(*keys).distinct(), keys, "left_anti")


def missing_cells(means: DataFrame, datasets: DataFrame, configs: DataFrame) -> DataFrame:
    """Pairs of a data set and a configuration that have no score; both lists are dimension tables."""
    return datasets.crossJoin(F.broadcast(configs)).join(means.select("dataset", "config"), ["dataset", "config"], "left_anti")


def first_crossing(sweep: DataFrame, limit: float) -> DataFrame:
    """``config, level, score`` from easy to hard: where the score first falls below ``limit``, interpolated."""
    w = Window.partitionBy("config").orderBy("level")
    n = sweep.withColumn("l2", F.lead("level").over(w)).withColumn("s2", F.lead("score").over(w))
    hit = n.filter((F.col("score") >= limit) & (F.col("s2") < limit))
    at = F.col("level") + (F.col("score") - limit) / (F.col("score") - F.col("s2")) * (F.col("l2") - F.col("level"))
    return hit.groupBy("config").agg(F.min_by(at, "level").alias("boundary"))


def failure_modes(contingency: DataFrame, min_share: float = 0.05, fragments: int = 5, merges: int = 3) -> DataFrame:
    """``truth, pred, n``: pieces a true class falls into, classes a predicted one holds, by share of each."""
    t, p = Window.partitionBy("truth"), Window.partitionBy("pred")
    s = contingency.withColumn("of_t", F.col("n") / F.sum("n").over(t)).withColumn("of_p", F.col("n") / F.sum("n").over(p))
    pieces = s.filter(F.col("of_t") >= min_share).groupBy("truth").agg(F.count("*").alias("k")).agg(F.max("k").alias("most_fragments"), F.avg("k").alias("mean_fragments"))
    held = s.filter(F.col("of_p") >= min_share).groupBy("pred").agg(F.count("*").alias("k")).agg(F.max("k").alias("most_merged"), F.avg("k").alias("mean_merged"))
    noise = s.agg((F.sum(F.when(F.col("of_t") < min_share, F.col("n")).otherwise(0)) / F.sum("n")).alias("noise"))
    out = pieces.crossJoin(held).crossJoin(noise)  # one row each
    return out.withColumn("fragmented", F.col("most_fragments") >= fragments).withColumn("merged", F.col("most_merged") >= merges)


def complexity(perf: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Exponent and r2 of y against x on a log-log scale."""
    lx, ly = F.log(F.col(x)), F.log(F.col(y))
    p = perf.filter((F.col(x) > 0) & (F.col(y) > 0)).select(by, lx.alias("lx"), ly.alias("ly"))
    return p.groupBy(by).agg(F.regr_slope("ly", "lx").alias("exponent"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"), F.count("*").alias("n"))


def admissible(meta: DataFrame, task: str, truths: tuple[str, ...]) -> DataFrame:
    """``meta`` with the reasons against each row; admitted if there are none."""
    reasons = [F.when(F.lower("task") != task, "task"), F.when(~F.col("truth").isin(*truths), "ground_truth"), F.when(F.col("n") < 2, "support")]
    return meta.withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ",")).withColumn("admitted", F.col("reasons") == "")


def capability(summary: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Weighted mean of the components that are there, weights made to sum to one."""
    w = sum((F.when(F.col(c).isNotNull(), x).otherwise(0.0) for c, x in parts.items()), F.lit(0.0))
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) * x for c, x in parts.items()), F.lit(0.0))
    return summary.withColumn("capability", F.when(w > 0, s / w))
