"""How methods fail: fragments, merges and crumbs of every run, collapse from easy to hard data, and the atlas of methods.

``runs(method, condition, run, truth, pred)`` has one row for an observation of a run; everything follows from its counts
of pairs of labels, which are partially aggregated, and does not depend on what labels are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import choose2, clip

#: Pieces and domains from which a run counts as fragmented or merged, shares below which a cluster is a crumb or a cell of the
#: contingency is overlooked, the score that separates success from failure, and the one of a collapse; fixed values.
FRAGMENTS, MERGES, CRUMB, LEAST_SHARE, TAU, COLLAPSE = 5, 3, 0.05, 0.05, 0.7, 0.2
MODES = ("fragmentation", "merge", "noise", "structural")
RUN = ["method", "condition", "run"]


def _claims(table: DataFrame, side: str, least: float) -> DataFrame:
    """Of every label of a side how many labels of the other hold a share of it; all of them, if none holds the least share."""
    whole = Window.partitionBy(*RUN, side)
    s = table.withColumn("of", F.col("n") / F.sum("n").over(whole))
    k = s.groupBy(*RUN, side).agg(F.count_if(F.col("of") >= least).alias("k"), F.count("*").alias("any"))
    return k.groupBy(*RUN).agg(F.max(F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("any"))).alias(f"most_{side}"))


def profiles(runs: DataFrame, fragments: int = FRAGMENTS, merges: int = MERGES, crumb: float = CRUMB, least: float = LEAST_SHARE) -> DataFrame:
    """One row for each run: severities of the three modes, whether each is past its limit, the counts, and the score (adjusted
    Rand index)."""
    table = runs.groupBy(*RUN, "truth", "pred").agg(F.count("*").alias("n"))
    sizes = table.groupBy(*RUN).agg(F.sum("n").alias("all"), F.sum(choose2(F.col("n"))).alias("ij"))
    t = table.groupBy(*RUN, "truth").agg(F.sum("n").alias("n")).groupBy(*RUN).agg(F.count("*").alias("n_true"), F.sum(choose2(F.col("n"))).alias("a"))
    per = table.groupBy(*RUN, "pred").agg(F.sum("n").alias("n")).join(sizes.select(*RUN, "all"), RUN)
    small = F.col("n") < crumb * F.col("all")
    p = per.groupBy(*RUN).agg(F.count("*").alias("n_pred"), F.sum(choose2(F.col("n"))).alias("b"), F.count_if(small).alias("n_micro"), F.sum(F.when(small, F.col("n")).otherwise(0)).alias("crumbs"))
    d = sizes.join(t, RUN).join(p, RUN).join(_claims(table, "truth", least), RUN).join(_claims(table, "pred", least), RUN)
    total = choose2(F.col("all"))
    expected, most = F.try_divide(F.col("a") * F.col("b"), total), (F.col("a") + F.col("b")) / 2
    ari = F.when((total == 0) | (most == expected), 1.0).otherwise(F.try_divide(F.col("ij") - expected, most - expected))
    share, held = F.col("n_micro") / F.col("n_pred"), F.col("crumbs") / F.col("all")
    noise = clip(0.5 * share + 0.5 * held / crumb, 0, 1)
    severity = lambda c, limit: clip((F.col(c) - 1) / max(limit - 1, 1), 0, 1)
    return d.select(
        *RUN, severity("most_truth", fragments).alias("fragmentation"), severity("most_pred", merges).alias("merge"), F.when(F.col("n_micro") >= 2, F.greatest(noise, share)).otherwise(noise).alias("noise"), ari.alias("ari"),
        (F.col("most_truth") >= fragments).alias("fragmented"), (F.col("most_pred") >= merges).alias("merged"), (F.col("n_micro") > 0).alias("noisy"), "n_true", "n_pred",
        F.col("most_truth").alias("most_fragments"), F.col("most_pred").alias("most_merged"), "n_micro", held.alias("micro_share"),
    )


def structural(easy: Column, hard: Column, tau: float = TAU, collapse: float = COLLAPSE) -> Column:
    """How far a method that works on easy data falls on hard data: 1 down to the collapse, 0 without a fall or where it never
    worked."""
    fall = clip((easy - hard) / F.greatest(easy - collapse, F.lit(1e-8)), 0, 1)
    return F.when(easy.isNull() | hard.isNull() | (easy < tau) | (easy <= hard), 0.0).when(hard <= collapse, 1.0).otherwise(fall)


def atlas(profiled: DataFrame, easy: str = "easy", tau: float = TAU) -> DataFrame:
    """One row for each method: the four severities over its hard runs (all runs where it has none), the dominant one, how many
    runs failed, and the mean scores on easy and hard data."""
    d = profiled.withColumn("hard", F.col("condition") != easy)
    used = d.withColumn("any_hard", F.max("hard").over(Window.partitionBy("method"))).withColumn("used", F.col("hard") | ~F.col("any_hard"))
    mine = lambda c: F.when(F.col("used"), c)
    failed = (F.col("ari") < tau) | F.col("fragmented") | F.col("merged") | F.col("noisy")
    a = used.groupBy("method").agg(
        *[F.avg(mine(F.col(m))).alias(m) for m in MODES[:3]], F.count_if(F.col("used")).alias("n_evaluations"), F.count_if(F.col("used") & failed).alias("n_failures"),
        F.avg(F.when(~F.col("hard"), F.col("ari"))).alias("ari_easy"), F.avg(F.when(F.col("hard"), F.col("ari"))).alias("ari_hard"),
    )
    a = a.withColumn("structural", structural(F.col("ari_easy"), F.col("ari_hard"), tau))
    top = F.greatest(*[F.round(m, 9) for m in MODES])
    dominant = F.when(top < 1e-9, "none")
    for m in MODES:
        dominant = dominant.when(F.round(m, 9) == top, m)
    return a.select("method", *MODES, dominant.alias("dominant_mode"), "n_evaluations", "n_failures", "ari_easy", "ari_hard")


def contributions(profiled: DataFrame, easy: str = "easy") -> DataFrame:
    """``method, condition, fragmentation, merge, noise``: the mean severities under each hard condition."""
    return profiled.filter(F.col("condition") != easy).groupBy("method", "condition").agg(*[F.avg(m).alias(m) for m in MODES[:3]])
