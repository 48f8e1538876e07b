"""Seeded tissues. Every draw is a hash of (seed, stream, ids), so a result does not depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *ids: str) -> Column:
    """In [0, 1), from 52 bits of a hash."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), *[F.col(i) for i in ids])
    return F.pmod(h, F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, stream: str, *ids: str) -> Column:
    """Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, stream + "r", *ids))) * F.cos(6.283185307179586 * uniform(seed, stream + "a", *ids))


def poisson(rate: Column, u: Column, most: int = 40) -> Column:
    """The inverse of the distribution function, summed up to ``most``: exact for the small rates of counts."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(s, i):
        p = s["p"] * rate / i
        return F.when(u < s["c"], s).otherwise(F.struct(p.alias("p"), (s["c"] + p).alias("c"), i.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["k"])


def make_tissue(spark: SparkSession, n_obs: int = 600, n_genes: int = 50, n_domains: int = 3, seed: int = 42, markers_each: int = 5, lift: float = 4.0) -> dict[str, DataFrame]:
    """``obs`` with positions in [0, 100)^2 and the true domain (that of the nearest seed point), ``var`` and ``expr``."""
    obs = spark.range(n_obs).select(F.col("id").alias("i")).withColumn("x", 100 * uniform(seed, "x", "i")).withColumn("y", 100 * uniform(seed, "y", "i"))
    centres = spark.range(n_domains).withColumnRenamed("id", "d").select("d", (100 * uniform(seed, "cx", "d")).alias("cx"), (100 * uniform(seed, "cy", "d")).alias("cy"))
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    near = obs.crossJoin(F.broadcast(centres)).groupBy("i", "x", "y").agg(F.min(F.struct(d2.alias("d2"), "d")).alias("m"))
    obs = near.select("i", F.format_string("cell_%05d", "i").alias("obs_id"), "x", "y", F.col("m.d").alias("domain_truth"))
    var = spark.range(n_genes).select(F.col("id").alias("g"), F.format_string("gene_%03d", "id").alias("gene_id"), (F.col("id") % 25 == 24).alias("mito"))
    marked = F.floor(F.col("g") / markers_each) == F.col("domain_truth")
    rate = F.exp(0.5 * normal(seed, "base", "g")) * F.when(marked, lift).otherwise(1.0)
    full = obs.crossJoin(F.broadcast(var))  # the dense grid is the result: every observation by every gene
    expr = full.select("obs_id", "gene_id", poisson(rate, uniform(seed, "count", "i", "g")).cast("double").alias("value")).filter("value > 0")
    return {"obs": obs.drop("i"), "var": var.drop("g"), "expr": expr}


def make_mixture(spark: SparkSession, n_spots: int = 300, n_types: int = 3, seed: int = 42) -> DataFrame:
    """``i, k, p``: proportions of each spot, gamma draws of shape 1 made to sum to one."""
    from pyspark.sql import Window

    g = spark.range(n_spots).select(F.col("id").alias("i")).crossJoin(F.broadcast(spark.range(n_types).select(F.col("id").alias("k")))).withColumn("w", -F.log(1 - uniform(seed, "mix", "i", "k")))
    return g.select("i", "k", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("p"))


def factorial(spark: SparkSession, **factors: list) -> DataFrame:
    """All combinations of small lists of levels: the plan of a study."""
    out = None
    for name, levels in factors.items():
        f = spark.createDataFrame([(x,) for x in levels], [name])
        out = f if out is None else out.crossJoin(F.broadcast(f))
    return out
