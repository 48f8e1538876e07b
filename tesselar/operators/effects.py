"""Effects with intervals: of a knob turned from its least to its greatest level, and of components within their donors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import drawn

#: Replicates that an effect needs at either level.
SUPPORT = 2


def _finite(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))


def grid_means(runs: DataFrame) -> DataFrame:
    """``config, level, score, n`` over finite replicates."""
    return _finite(runs).groupBy("config", "level").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def causal_effects(runs: DataFrame, draws: int = 200, alpha: float = 0.05) -> DataFrame:
    """For each configuration of ``runs(config, level, replicate, score)`` the mean at the greatest level less that at the least, with
    an interval over replicates, which are resampled at either level for themselves.

    All configurations and draws are one pass. Without ``SUPPORT`` finite replicates at both levels there is no effect.
    """
    ends = runs.agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    d = _finite(runs).crossJoin(F.broadcast(ends)).filter((F.col("level") == F.col("lo")) | (F.col("level") == F.col("hi"))).withColumn("side", F.when(F.col("level") == F.col("hi"), "hi").otherwise("lo"))
    d = d.select("config", "side", F.concat_ws(":", "side", "replicate").alias("unit"), "score")
    side = lambda s, c="score": F.avg(F.when(F.col("side") == s, F.col(c)))
    n = lambda s: F.count_if(F.col("side") == s)
    point = runs.select("config").distinct().join(d.groupBy("config").agg(side("lo").alias("score_lo"), side("hi").alias("score_hi"), n("lo").alias("support_lo"), n("hi").alias("support_hi")), "config", "left").fillna(0, ["support_lo", "support_hi"])
    per = drawn(d, draws).groupBy("config", "draw", "side").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("m")).groupBy("config", "draw").agg((side("hi", "m") - side("lo", "m")).alias("e"))
    q = per.groupBy("config").agg(F.percentile("e", alpha / 2).alias("lo"), F.percentile("e", 1 - alpha / 2).alias("hi"))
    enough = (F.col("support_lo") >= SUPPORT) & (F.col("support_hi") >= SUPPORT)
    out = point.join(q, "config", "left")
    return out.select("config", F.when(enough, F.col("score_hi") - F.col("score_lo")).alias("effect"), F.when(enough, F.col("lo")).alias("ci_low"), F.when(enough, F.col("hi")).alias("ci_high"), F.coalesce(enough & ((F.round("lo", 12) > 0) | (F.round("hi", 12) < 0)), F.lit(False)).alias("significant"), "score_lo", "score_hi", "support_lo", "support_hi")


def admitted(components: DataFrame, expected: str, require_direction: bool = True) -> DataFrame:
    """The components of one expected class; with ``require_direction`` those alone that point where they should."""
    d = components.filter(F.col("expected_class") == expected)
    return d.filter("direction_ok") if require_direction else d


def _donor_means(d: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """Of each donor the means of both effects weighted by size (plain, where no size is above 0) and the share of components that
    rise in the one and fall in the other."""
    w = F.col(weight) * F.col("n")
    mean = lambda c: F.when(F.sum(w) > 0, F.try_divide(F.sum(w * F.col(c)), F.sum(w))).otherwise(F.sum(F.col(weight) * F.col(c)) / F.sum(weight))
    ok = F.when((F.col("up") > 0) & (F.col("down") < 0), 1.0).otherwise(0.0)
    return d.groupBy(*by).agg(F.count("*").alias("n_components"), F.sum("n").alias("n_spots"), mean("up").alias("up"), mean("down").alias("down"), (F.sum(F.col(weight) * ok) / F.sum(weight)).alias("direction_rate"))


def donor_means(components: DataFrame) -> DataFrame:
    """``donor, n_components, n_spots, up, down, direction_rate`` of ``components(donor, component, up, down, n)``."""
    return _donor_means(components.withColumn("_one", F.lit(1)), "_one", ["donor"])


def donor_bootstrap(components: DataFrame, draws: int = 200, level: float = 0.95) -> DataFrame:
    """``effect, mean, median, ci_low, ci_high, std, donors``: donors count alike, and components are resampled within each. A donor
    of whom a draw takes nothing is left out of that draw."""
    effects = ("up", "down", "direction_rate")
    long = lambda d: d.select(*[c for c in d.columns if c in ("draw",)], F.expr("stack(3, " + ", ".join(f"'{e}', {e}" for e in effects) + ") as (effect, value)"))
    point = long(donor_means(components)).groupBy("effect").agg(F.avg("value").alias("mean"), F.count("*").alias("donors"))
    units = components.withColumn("unit", F.concat_ws(":", "donor", "component"))
    per = _donor_means(drawn(units, draws), "w", ["draw", "donor"])
    spread = long(per).groupBy("effect", "draw").agg(F.avg("value").alias("m")).groupBy("effect").agg(F.median("m").alias("median"), F.percentile("m", (1 - level) / 2).alias("ci_low"), F.percentile("m", (1 + level) / 2).alias("ci_high"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std"))
    return point.join(spread, "effect")


def ensemble_strategy(ranked: DataFrame, strong: float = 0.10, marginal: float = 0.03) -> DataFrame:
    """For each request of ``ranked(q, config, score, rank)`` what to do with the first two: ``only`` one has evidence, the first is
    ``strong`` or ``preferred`` by its lead, or both are run and what they agree on counts (``consensus``)."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    d = ranked.filter("rank <= 2").groupBy("q").agg(at(1, "config").alias("first"), at(2, "config").alias("second"), F.round(at(1, "score") - at(2, "score"), 9).alias("lead"))
    return d.withColumn("strategy", F.when(F.col("second").isNull(), "only").when(F.col("lead") > strong, "strong").when(F.col("lead") > marginal, "preferred").otherwise("consensus"))


def consensus_labels(labels: DataFrame) -> DataFrame:
    """``i, label``: what two methods' matched labels ``(i, method, label)`` agree on, ``uncertain`` where they differ."""
    n = Window.partitionBy("i")
    d = labels.withColumn("lo", F.min("label").over(n)).withColumn("hi", F.max("label").over(n))
    return d.select("i", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("uncertain").alias("label")).distinct()
