"""Quality control of observations. Inputs: ``expr(obs_id, gene_id, value)`` without zeros, ``var(gene_id, mito)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio

#: Makes the median absolute deviation of a normal sample its standard deviation.
MAD_SCALE = 1.4826


def quantile(df: DataFrame, value: Column, q: float) -> DataFrame:
    """One row ``q``: the exact interpolated quantile. Equal values are counted before they meet."""
    return df.select(value.alias("_v")).groupBy("_v").agg(F.count("*").alias("_n")).agg(F.percentile("_v", q, F.col("_n")).alias("q"))


def obs_stats(expr: DataFrame, var: DataFrame | None = None) -> DataFrame:
    """``obs_id, total, n_genes[, mito_pct]``; one shuffle, partially aggregated."""
    aggs = [F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes")]
    if var is not None:
        expr = expr.join(var.select("gene_id", "mito"), "gene_id", "left")
        aggs.append(F.sum(F.when(F.col("mito"), F.col("value")).otherwise(0.0)).alias("mito"))
    out = expr.groupBy("obs_id").agg(*aggs)
    return out if var is None else out.withColumn("mito_pct", ratio(F.col("mito") * 100.0, F.col("total"))).drop("mito")


def within_mads(df: DataFrame, value: Column, n_mads: float, name: str) -> DataFrame:
    """``df`` with whether a value lies within ``n_mads`` scaled median deviations of the median; all do if that is 0."""
    m = quantile(df, value, 0.5).withColumnRenamed("q", "_median")
    df = df.crossJoin(F.broadcast(m))  # one row
    d = quantile(df, F.abs(value - F.col("_median")), 0.5).withColumnRenamed("q", "_mad")
    df = df.crossJoin(F.broadcast(d))
    ok = (F.col("_mad") == 0) | (F.abs(value - F.col("_median")) <= n_mads * F.col("_mad") * MAD_SCALE)
    return df.withColumn(name, ok).drop("_median", "_mad")


def basic_qc(expr: DataFrame, var: DataFrame, n_mads: float = 5.0, min_counts: float = 10, min_genes: int = 3, max_mito_pct: float = 40.0) -> DataFrame:
    """Statistics of the observations that pass every test."""
    s = obs_stats(expr, var)
    s = within_mads(s, F.log1p("total"), n_mads, "_counts_ok")
    s = within_mads(s, F.log1p(F.col("n_genes").cast("double")), n_mads, "_genes_ok")
    keep = F.col("_counts_ok") & F.col("_genes_ok") & (F.col("total") >= min_counts) & (F.col("n_genes") >= min_genes) & (F.col("mito_pct") <= max_mito_pct)
    return s.filter(keep).drop("_counts_ok", "_genes_ok")


def gene_complexity_qc(expr: DataFrame, min_genes: int = 100) -> DataFrame:
    return obs_stats(expr).select("obs_id", "n_genes", (F.col("n_genes") < min_genes).alias("low_complexity"))


def library_size_qc(expr: DataFrame, min_counts: float = 500.0) -> DataFrame:
    return obs_stats(expr).select("obs_id", "total", (F.col("total") < min_counts).alias("low_counts"))


def mitochondrial_qc(expr: DataFrame, var: DataFrame, max_fraction: float = 0.2) -> DataFrame:
    s = obs_stats(expr, var)
    return s.select("obs_id", (F.col("mito_pct") / 100.0).alias("mito_fraction")).withColumn("high_mito", F.col("mito_fraction") > max_fraction)


def flagged(df: DataFrame, score: str, fraction: float, high_is_bad: bool) -> DataFrame:
    """``flag``: strictly beyond the quantile of the score."""
    q = quantile(df, F.col(score), 1 - fraction if high_is_bad else fraction)
    out = df.crossJoin(F.broadcast(q))
    return out.withColumn("flag", F.col(score) > F.col("q") if high_is_bad else F.col(score) < F.col("q")).drop("q")


def adaptive_saturation_qc(expr: DataFrame, n_vars: DataFrame, flag_fraction: float = 0.05) -> DataFrame:
    """Detected genes against those expected at the observation's depth; ``n_vars`` is one row, one column."""
    s = obs_stats(expr)
    scale = quantile(s.filter("total > 0"), F.col("total"), 0.5).select((F.coalesce("q", F.log(F.lit(2.0))) / F.log(F.lit(2.0))).alias("_scale"))
    s = s.crossJoin(F.broadcast(scale)).crossJoin(F.broadcast(n_vars.toDF("_vars")))
    expected = F.col("_vars") * (1.0 - F.exp(-F.col("total") / F.greatest("_scale", F.lit(1e-12))))
    s = s.select("obs_id", clip(ratio(F.col("n_genes").cast("double"), expected), 0, 2).alias("score"))
    return flagged(s, "score", flag_fraction, False)


def _neighbour_means(v: DataFrame, edges: DataFrame) -> DataFrame:
    """``i, gene, m``: mean over the neighbours of i, absent values counting as zero."""
    k = edges.groupBy("i").agg(F.count("*").alias("_k"))
    near = edges.join(v.select(F.col("i").alias("j"), "gene", "v"), "j").groupBy("i", "gene").agg(F.sum("v").alias("_s"))
    return near.join(k, "i").select("i", "gene", (F.col("_s") / F.col("_k")).alias("m"))


def spatial_entropy_qc(v: DataFrame, edges: DataFrame, flag_fraction: float = 0.05) -> DataFrame:
    """Normalised entropy of the composition averaged with the neighbours'; ``v(i, gene, v)`` non-negative."""
    near = _neighbour_means(v, edges)
    local = v.select("i", "gene", "v").join(near, ["i", "gene"], "full").select("i", (0.5 * (F.coalesce("v", F.lit(0.0)) + F.coalesce("m", F.lit(0.0)))).alias("p")).filter("p > 0")
    s = local.groupBy("i").agg(F.sum("p").alias("t"), F.sum(F.col("p") * F.log("p")).alias("pl"), F.count("*").alias("n"))
    entropy = -(F.col("pl") / F.col("t") - F.log("t"))
    s = s.select("i", clip(F.when(F.col("n") > 1, entropy / F.log(F.col("n").cast("double"))).otherwise(0.0), 0, 1).alias("score"))
    return flagged(s, "score", flag_fraction, False)


def neighbor_discordance_qc(v: DataFrame, edges: DataFrame, flag_fraction: float = 0.05) -> DataFrame:
    """Jensen-Shannon divergence (base 2) between an observation's composition and its neighbours'."""
    near = _neighbour_means(v, edges)
    both = v.select("i", "gene", "v").join(near, ["i", "gene"], "full").select("i", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("m", F.lit(0.0)).alias("m"))
    sums = both.groupBy("i").agg(F.sum("v").alias("tv"), F.sum("m").alias("tm"))
    p = both.join(sums, "i").select("i", ratio(F.col("v"), F.col("tv")).alias("p"), ratio(F.col("m"), F.col("tm")).alias("q"))
    mid = 0.5 * (F.col("p") + F.col("q"))
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / mid)).otherwise(0.0)
    s = p.groupBy("i").agg((0.5 * F.sum(term("p") + term("q")) / F.log(F.lit(2.0))).alias("score")).select("i", clip(F.col("score"), 0, 1).alias("score"))
    return flagged(s, "score", flag_fraction, True)
