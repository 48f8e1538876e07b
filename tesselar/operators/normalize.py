"""Normalisations of ``expr(obs_id, gene_id, value)``. Zeros are absent; where they would map to another value, it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio
from .qc import _neighbour_means

def _row():
    return Window.partitionBy("obs_id")


def _scaled(expr: DataFrame, target: float):
    return ratio(F.col("value") * target, F.sum("value").over(_row()))


def library_size_scale(expr: DataFrame, target_sum: float = 1e4) -> DataFrame:
    return expr.withColumn("value", _scaled(expr, target_sum))


def log1p_cp10k(expr: DataFrame, target_sum: float = 1e4) -> DataFrame:
    return expr.withColumn("value", F.log1p(_scaled(expr, target_sum)))


def sqrt_transform(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.sqrt("value"))


def arcsinh_transform(expr: DataFrame, cofactor: float = 5.0) -> DataFrame:
    return expr.withColumn("value", F.asinh(F.col("value") / cofactor))


def clr_per_cell(expr: DataFrame, n_vars: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """``value`` of the entries and ``zero_value``, which all absent entries of the row take."""
    log = F.log(F.col("value") + pseudocount)
    zero = F.log(F.lit(float(pseudocount)))
    d = expr.crossJoin(F.broadcast(n_vars.toDF("_vars")))
    mean = (F.sum(log).over(_row()) + (F.col("_vars") - F.count("*").over(_row())) * zero) / F.col("_vars")
    return d.select("obs_id", "gene_id", (log - mean).alias("value"), (zero - mean).alias("zero_value"))


def tfidf_l2(expr: DataFrame) -> DataFrame:
    """Term frequency times log1p(N / (1 + df)), rows of length one."""
    n = expr.select("obs_id").distinct().agg(F.count("*").alias("_n"))
    idf = expr.filter("value > 0").groupBy("gene_id").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(n)).select("gene_id", F.log1p(F.col("_n") / (1.0 + F.col("_df"))).alias("_idf"))
    w = expr.withColumn("value", ratio(F.col("value"), F.sum("value").over(_row()))).join(idf, "gene_id").withColumn("value", F.col("value") * F.col("_idf"))
    return w.select("obs_id", "gene_id", ratio(F.col("value"), F.sqrt(F.sum(F.col("value") * F.col("value")).over(_row()))).alias("value"))


def rank_stabilize(expr: DataFrame, scale: float = 1.0) -> DataFrame:
    """Average rank among the row's positive values, over their number."""
    pos = expr.filter("value > 0")
    ties = Window.partitionBy("obs_id", "value")
    rank = F.rank().over(_row().orderBy("value")) + (F.count("*").over(ties) - 1) / 2.0
    return pos.select("obs_id", "gene_id", (rank / F.count("*").over(_row()) * scale).alias("value"))


def robust_pearson_residual(expr: DataFrame, n_vars: DataFrame, theta: float = 100.0, gene_prior: float = 1.0, clip_at: float = 10.0) -> DataFrame:
    """Residuals of the entries; an absent entry's is that of value 0 with the returned ``expected`` of its row and gene."""
    total = expr.agg(F.sum("value").alias("_all"))
    genes = expr.groupBy("gene_id").agg(F.sum("value").alias("_gene"))
    d = expr.join(genes, "gene_id").withColumn("_row", F.sum("value").over(_row())).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n_vars.toDF("_vars")))
    mu = F.col("_row") * (F.col("_gene") + gene_prior) / (F.col("_all") + gene_prior * F.col("_vars"))
    var = mu + mu * mu / theta
    return d.select("obs_id", "gene_id", clip(F.when(var > 0, (F.col("value") - mu) / F.sqrt(var)).otherwise(0.0), -clip_at, clip_at).alias("value"), mu.alias("expected"))


def pearson_residuals(v: DataFrame, theta: float = 100.0, gene_prior: float = 1.0, clip_at: float = 10.0) -> DataFrame:
    """``robust_pearson_residual`` of a dense matrix ``v(i, gene, v)``: zeros have their residuals too. Row and gene totals are
    summaries that are joined back; a matrix without counts expects the same of all genes, which is 0."""
    rows, genes = v.groupBy("i").agg(F.sum("v").alias("_row")), v.groupBy("gene").agg(F.sum("v").alias("_gene"))
    whole = genes.agg(F.sum("_gene").alias("_all"), F.count("*").alias("_vars"))
    d = v.join(rows, "i").join(genes, "gene").crossJoin(F.broadcast(whole))
    share = F.coalesce(F.try_divide(F.col("_gene") + gene_prior, F.col("_all") + gene_prior * F.col("_vars")), 1.0 / F.col("_vars"))
    mu = F.col("_row") * share
    return d.select("i", "gene", clip(F.coalesce(F.try_divide(F.col("v") - mu, F.sqrt(mu + mu * mu / theta)), F.lit(0.0)), -clip_at, clip_at).alias("v"))


def spatial_median_normalize(v: DataFrame, edges: DataFrame, target_sum: float = 1e4, spatial_weight: float = 0.5) -> DataFrame:
    """Depth blended with the median of the own and the neighbours' depths; ``v(i, gene, v)``."""
    t = v.groupBy("i").agg(F.sum("v").alias("t"))
    own = t.select("i", "t").unionByName(edges.join(t.select(F.col("i").alias("j"), "t"), "j").select("i", "t"))
    med = own.groupBy("i").agg(F.median("t").alias("_m"))
    depth = (1 - spatial_weight) * F.col("t") + spatial_weight * F.col("_m")
    f = t.join(med, "i").select("i", ratio(F.lit(float(target_sum)), depth).alias("_f"))
    return v.join(f, "i").select("i", "gene", (F.col("v") * F.col("_f")).alias("v"))


def graph_diffusion_normalize(v: DataFrame, edges: DataFrame, target_sum: float = 1e4, diffusion: float = 0.25, steps: int = 2) -> DataFrame:
    """log1p of scaled counts, then ``steps`` rounds of mixing with the neighbours' mean."""
    w = Window.partitionBy("i")
    state = v.select("i", "gene", F.log1p(ratio(F.col("v") * target_sum, F.sum("v").over(w))).alias("v"))
    for _ in range(steps):
        near = _neighbour_means(state, edges)
        state = state.join(near, ["i", "gene"], "full").select("i", "gene", ((1 - diffusion) * F.coalesce("v", F.lit(0.0)) + diffusion * F.coalesce("m", F.lit(0.0))).alias("v"))
    return state
