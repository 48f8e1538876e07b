"""Studies over evidence: what to measure next, what knowing the answer is worth, who wins under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .evidence import pareto_frontier


def oracle_leakage(perf: DataFrame) -> DataFrame:
    """``config, mode, score`` with modes oracle and estimate: mean of each, the drop, and the share that is recovered."""
    p = perf.groupBy("config").pivot("mode", ["oracle", "estimate"]).agg(F.avg("score"))
    return p.withColumn("drop", F.col("oracle") - F.col("estimate")).withColumn("recovery", F.when(F.col("oracle") > 0, F.col("estimate") / F.col("oracle")))


def under_budget(perf: DataFrame, seconds: float) -> DataFrame:
    """The winner of each data set among runs within the budget, and how many were not."""
    ok = F.col("secs") <= seconds
    m = perf.groupBy("dataset", "config").agg(F.avg(F.when(ok, F.col("score"))).alias("score"), F.count_if(~ok).alias("rejected"))
    w = Window.partitionBy("dataset")
    m = m.withColumn("all_rejected", F.sum("rejected").over(w))
    best = m.filter(F.col("score").isNotNull()).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "config")))
    return best.filter("r = 1").select("dataset", "config", "score", F.col("all_rejected").alias("rejected"))


def effect(perf: DataFrame, factor: str) -> DataFrame:
    """``config, effect``: mean score at the factor's upper half less that at its lower, over data sets."""
    mid = perf.agg(F.percentile(factor, 0.5).alias("mid"))
    d = perf.crossJoin(F.broadcast(mid)).withColumn("high", F.col(factor) > F.col("mid"))
    m = d.groupBy("config", "dataset").agg(F.avg(F.when(F.col("high"), F.col("score"))).alias("hi"), F.avg(F.when(~F.col("high"), F.col("score"))).alias("lo"))
    return m.filter(F.col("hi").isNotNull() & F.col("lo").isNotNull()).groupBy("config").agg(F.avg(F.col("hi") - F.col("lo")).alias("effect"), F.stddev_samp(F.col("hi") - F.col("lo")).alias("sd"), F.count("*").alias("n"))


def coverage(perf: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Per configuration: runs, runs that gave a result, and their share."""
    ok = ~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*statuses)
    return perf.groupBy("config").agg(F.count("*").alias("runs"), F.count_if(ok).alias("ok"), (F.count_if(ok) / F.count("*")).alias("share"))


def by_study(means: DataFrame, study: DataFrame) -> DataFrame:
    """Scores averaged in each study before studies are averaged, so that a study with many data sets counts once."""
    u = means.join(F.broadcast(study), "dataset").groupBy("study", "config").agg(F.avg("score").alias("score"))
    return u.groupBy("config").agg(F.avg("score").alias("score"), F.count("*").alias("studies"))


def hold_out_studies(means: DataFrame, study: DataFrame) -> DataFrame:
    """For each study the configuration best in the others, and its regret here; sums are taken once and the own part left out."""
    u = means.join(F.broadcast(study), "dataset").groupBy("study", "config").agg(F.avg("score").alias("score"))
    w, here = Window.partitionBy("config"), Window.partitionBy("study")
    t = u.withColumn("train", (F.sum("score").over(w) - F.col("score")) / (F.count("*").over(w) - 1)).filter(F.col("train").isNotNull())
    t = t.withColumn("oracle", F.max("score").over(here)).withColumn("r", F.row_number().over(here.orderBy(F.desc(F.round("train", 9)), "config")))
    return t.filter("r = 1").select("study", "config", (F.col("oracle") - F.col("score")).alias("regret"))


def pareto_stability(perf: DataFrame, directions: dict[str, str], draws: int = 16) -> DataFrame:
    """``config, inclusion, stable``: in how many hash-drawn resamples of the data sets a configuration is on the front."""
    d = perf.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    times = F.ascii(F.substring(F.md5(F.concat_ws(":", "b", "dataset")), 1, 1)) % 4
    o = d.withColumn("t", times).groupBy("b", "config").agg(F.round(ratio(F.sum(F.col("t") * F.col("score")), F.sum("t").cast("double")), 9).alias("accuracy"), F.round(ratio(F.sum(F.col("t") * F.col("secs")), F.sum("t").cast("double")), 9).alias("speed"))
    f = pareto_frontier(o, directions, by="b").groupBy("config").agg((F.count("*") / draws).alias("inclusion"))
    return f.withColumn("stable", F.col("inclusion") >= 0.5)


def weighted_by_donor(rows: DataFrame) -> DataFrame:
    """``donor, value, weight``: weighted means in donors, then donors alike."""
    d = rows.groupBy("donor").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("m"), (F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("n_eff"))
    return d.agg(F.avg("m").alias("mean"), F.avg("n_eff").alias("effective_n"), F.count("*").alias("donors"))


def cumulative_share(rows: DataFrame, value: str, key: str, share: float) -> DataFrame:
    """How many of the largest values make up ``share`` of the total."""
    w = Window.orderBy(F.desc(value), key)
    c = rows.withColumn("c", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum(value).over(Window.partitionBy())).withColumn("r", F.row_number().over(w))
    return c.filter(F.round(F.col("c") / F.col("t"), 9) >= share).agg(F.min("r").alias("n"))


def cluster_count_curve(emb: DataFrame, ks: list[int]) -> DataFrame:
    """``k, ch``: Calinski and Harabasz's index of k-means for each k; the best k has the largest."""
    from .domains import kmeans, long

    x, out = long(emb), None
    total = x.groupBy("gene").agg((F.var_pop("v") * F.count("*")).alias("s")).agg(F.sum("s").alias("total"))
    n = emb.agg(F.count("*").alias("n"))
    for k in ks:
        lab = kmeans(emb, k)
        within = x.join(lab, "i").groupBy("domain", "gene").agg((F.var_pop("v") * F.count("*")).alias("s")).agg(F.sum("s").alias("within"))
        one = within.crossJoin(total).crossJoin(n).select(F.lit(k).alias("k"), (((F.col("total") - F.col("within")) / (k - 1)) / (F.col("within") / (F.col("n") - k))).alias("ch"))
        out = one if out is None else out.unionByName(one)
    return out
