"""Batch alignment. Inputs: ``v(i, gene, v)`` and ``batch(i, batch)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import saved
from .graph import fused_pairs, knn
from .relational import range_ranks
from .svg import _pairs


def combat(v: DataFrame, batch: DataFrame) -> DataFrame:
    """Each batch's genes standardised by their own mean and variance, the variance of what is left drawn towards 1, then put on
    the scale that the gene has over all batches.

    All estimates are summaries of (batch, gene) or gene, partially aggregated; observations are joined with them once. The
    mean of what is standardised by its own mean is 0, so its shrinkage adds nothing. One value alone has no variance.
    """
    d = v.join(batch, "i")
    var = lambda c: F.coalesce(F.var_samp(c), F.lit(0.0))
    cell = d.groupBy("batch", "gene").agg(F.count("*").alias("n"), F.avg("v").alias("m"), var("v").alias("s"))
    gene = d.groupBy("gene").agg(F.avg("v").alias("grand"), (var("v") + 1e-8).alias("spread"))
    left = F.col("s") / (F.col("s") + 1e-8) + 1e-8
    cell = cell.withColumn("delta", F.greatest((F.col("n") * left + 2 * PRIOR_WEIGHT) / (F.col("n") + 2 * PRIOR_WEIGHT), F.lit(1e-8))).join(gene, "gene")
    scale = F.sqrt(F.col("spread") / ((F.col("s") + 1e-8) * F.col("delta")))
    cell = cell.select("batch", "gene", F.col("m").alias("_m"), "grand", scale.alias("scale"))
    return d.join(cell, ["batch", "gene"]).select("i", "gene", ((F.col("v") - F.col("_m")) * F.col("scale") + F.col("grand")).alias("v"))


#: Weight of the prior variance 1 in ``combat``, as half a number of observations; a fixed value.
PRIOR_WEIGHT = 2.0


def combat_ranks(v: DataFrame, batch: DataFrame) -> DataFrame:
    """Each value replaced by the quantile of its gene over all batches at (rank - 1/2) / n of its own batch, ties averaged,
    interpolated between the two values around it.

    Ranks come from ``relational.range_ranks``, so no task holds a gene's whole column; a row then asks for the two values
    around its place by their ranks.
    """
    d = v.join(batch, "i").select("i", "gene", "batch", "v")
    own = range_ranks(d, ["gene", "batch"], "v", "i", "at")
    ties = own.groupBy("gene", "batch", "v").agg((F.avg("at")).alias("rank"))  # equal values lie side by side
    sizes = d.groupBy("gene", "batch").agg(F.count("*").alias("n"))
    whole = d.groupBy("gene").agg(F.count("*").alias("all"))
    place = (F.col("rank") - 0.5) / F.col("n") * (F.col("all") - 1)
    asked = ties.join(sizes, ["gene", "batch"]).join(whole, "gene").select("gene", "batch", "v", place.alias("place"), F.floor(place).alias("lo"), F.least(F.floor(place) + 1, F.col("all") - 1).alias("hi"))
    pooled = range_ranks(d, ["gene"], "v", "i", "at").select("gene", (F.col("at") - 1).alias("at"), F.col("v").alias("q"))
    low = asked.join(pooled.withColumnsRenamed({"at": "lo", "q": "a"}), ["gene", "lo"])
    both = low.join(pooled.withColumnsRenamed({"at": "hi", "q": "b"}), ["gene", "hi"])
    new = both.select("gene", "batch", "v", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("lo"))).alias("new"))
    return d.join(new, ["gene", "batch", "v"]).select("i", "gene", F.col("new").alias("v"))


def quantile_align(v: DataFrame, batch: DataFrame, points: DataFrame | None = None, k: int = 6, blend: float = 0.2) -> DataFrame:
    """Each value moved to the mean over all batches of the quantile it has in its own, (rank - 1/2) / n, interpolated; then
    blended with the mean of its k neighbours in the batch, where ``points`` are given.

    Quantiles are looked up by rank: a row asks each batch for the two values around its place, so nothing is collected.
    """
    d = v.join(batch, "i")
    w = Window.partitionBy("batch", "gene")
    order = w.orderBy("v", "i")
    ranked = d.select("i", "batch", "gene", "v", F.row_number().over(order).alias("at"), (F.rank().over(w.orderBy("v")) + (F.count("*").over(Window.partitionBy("batch", "gene", "v")) - 1) / 2.0).alias("rank"), F.count("*").over(w).alias("n"))
    ranked = saved(ranked, "ranked")
    sizes = ranked.groupBy("gene", F.col("batch").alias("other")).agg(F.count("*").alias("m"))
    asked = ranked.withColumn("u", (F.col("rank") - 0.5) / F.col("n")).join(sizes, "gene")
    place = F.col("u") * (F.col("m") - 1)
    asked = asked.select("i", "batch", "gene", "other", place.alias("place"), F.floor(place).alias("lo"), "m")
    held = ranked.select("gene", F.col("batch").alias("other"), "at", F.col("v").alias("q"))
    low = asked.join(held.withColumn("lo", F.col("at") - 1).drop("at").withColumnRenamed("q", "a"), ["gene", "other", "lo"])
    both = low.withColumn("hi", F.least(F.col("lo") + 1, F.col("m") - 1)).join(held.withColumn("hi", F.col("at") - 1).drop("at").withColumnRenamed("q", "b"), ["gene", "other", "hi"])
    moved = both.groupBy("i", "batch", "gene").agg(F.avg(F.col("a") + (F.col("place") - F.col("lo")) * (F.col("b") - F.col("a"))).alias("v"))
    if points is None or blend == 0:
        return moved.select("i", "gene", "v")
    moved = saved(moved, "aligned")
    near = knn(points.select("i", "x", "y").join(batch, "i"), k, within="batch")
    local = _pairs(moved.select("i", "gene", "v"), near.select("i", "j")).groupBy("i", "gene").agg(F.avg("vj").alias("m"))
    return moved.join(local, ["i", "gene"], "left").select("i", "gene", ((1 - blend) * F.col("v") + blend * F.coalesce("m", F.col("v"))).alias("v"))


def largest_batch(batch: DataFrame) -> DataFrame:
    """One row: the batch with most observations, the smaller label on ties."""
    return batch.groupBy("batch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "batch").limit(1).select(F.col("batch").alias("ref"))


def centre_batches(v: DataFrame, batch: DataFrame) -> DataFrame:
    """Values less the difference of the batch's gene median from that of the largest batch."""
    d = v.join(batch, "i")
    med = d.groupBy("batch", "gene").agg(F.median("v").alias("med"))
    base = med.join(F.broadcast(largest_batch(batch)), F.col("batch") == F.col("ref")).select("gene", F.col("med").alias("base"))
    shift = med.join(base, "gene").select("batch", "gene", (F.col("med") - F.col("base")).alias("shift"))
    return d.join(shift, ["batch", "gene"]).select("i", "gene", (F.col("v") - F.col("shift")).alias("v"))


def anchor_residuals(v: DataFrame, batch: DataFrame, points: DataFrame, vectors: DataFrame, spatial_weight: float = 1.0) -> DataFrame:
    """Values less, for each batch but the largest, the gene's median difference over the batch's anchors in the largest.

    Anchors are pairs that are each other's nearest in the sum of scaled distances between ``vectors(i, vec)`` and in place.
    """
    ref = largest_batch(batch).first()[0]
    p = saved(points.select("i", "x", "y").join(vectors, "i").join(batch, "i"), "anchor_points")
    base = p.filter(F.col("batch") == ref)
    found = None
    for label in sorted(r[0] for r in batch.select("batch").distinct().collect()):  # batches, not observations
        if label != ref:
            pairs = fused_anchors(p.filter(F.col("batch") == label), base, spatial_weight).select("i", "j", F.lit(label).alias("batch"))
            found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return v.select("i", "gene", "v")
    values = v.select("i", "gene", "v")
    apart = found.join(values, "i").join(values.select(F.col("i").alias("j"), "gene", F.col("v").alias("vj")), ["j", "gene"])
    shift = apart.groupBy("batch", "gene").agg(F.median(F.col("v") - F.col("vj")).alias("shift"))
    return v.join(batch, "i").join(shift, ["batch", "gene"], "left").select("i", "gene", (F.col("v") - F.coalesce("shift", F.lit(0.0))).alias("v"))


def _cross_scale(left: DataFrame, right: DataFrame, samples: int = 256) -> tuple[float, float]:
    """Median positive distances between ``samples`` rows of each, taken evenly by id: in place, and between vectors."""

    def some(df: DataFrame) -> list:
        n = df.count()
        at = sorted({int(x) for x in np.linspace(0, n - 1, num=min(n, samples))})
        rows = df.withColumn("_at", F.row_number().over(Window.orderBy("i")) - 1).filter(F.col("_at").isin(at)) if n > samples else df
        return rows.orderBy("i").select("x", "y", "vec").collect()

    a, b = some(left), some(right)
    out = []
    for get in (lambda r: [r.x, r.y], lambda r: r.vec):
        one, two = (np.array([get(r) for r in rows], float) for rows in (a, b))
        d = np.sqrt(((one[:, None] - two[None]) ** 2).sum(2))
        out.append(float(np.median(d[d > 0])) if (d > 0).any() else 1.0)
    return out[0], out[1]


def fused_anchors(target: DataFrame, base: DataFrame, spatial_weight: float = 1.0) -> DataFrame:
    """``i, j`` that are each other's nearest, ties to the smaller id."""
    in_place, between = _cross_scale(target, base)
    to = fused_pairs(target, base, 1, spatial_weight / in_place, 1 / between, excluded=False).select("i", "j")
    back = fused_pairs(base, target, 1, spatial_weight / in_place, 1 / between, excluded=False).select(F.col("i").alias("j"), F.col("j").alias("i"))
    return to.join(back, ["i", "j"])


def mutual_anchors(points: DataFrame, batch: DataFrame, a: object, b: object) -> DataFrame:
    """Pairs of observations, one of each batch, that are each other's nearest; grid cells bound the search.

    The nearest of the other batch is found by a ring search as in ``graph.knn``, over one batch's cells.
    """
    from .graph import knn_between

    p = points.join(batch, "i")
    one, two = p.filter(F.col("batch") == a), p.filter(F.col("batch") == b)
    ab, ba = knn_between(one, two), knn_between(two, one)
    return ab.join(ba.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"]).select("i", "j", "d2")
