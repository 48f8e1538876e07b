"""A digital twin of a sample: new values at the same places, with the sample's domains, moments and spatial dependence.

Of every domain and gene the twin has the mean and the deviation. What varies beside them is drawn: independent normal noise,
mixed with the same noise smoothed over neighbours in the share that gives each gene the spatial autocorrelation it has in
the sample. All shares are tried at once, since a mixture's autocorrelation follows from three sums over edges and three over
points; so a twin costs the same however many trials it has. Draws come from hashes of seed, place and gene.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import saved
from .graph import symmetric
from .kselect import uniform
from .svg import pairs

#: Shares of smoothed noise that are tried.
TRIALS = tuple(k / 10 for k in range(10))


def noise(seed: int, *key: str) -> Column:
    """A standard normal draw from the hash of its key."""
    return F.sqrt(-2 * F.log(uniform(F.lit(seed), F.lit("a"), *key))) * F.cos(2 * math.pi * uniform(F.lit(seed), F.lit("b"), *key))


def standardized(d: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with mean 0 and deviation 1 within each domain and gene; constant ones are 0. Moments, a row for
    each domain and gene, are broadcast."""
    m = d.groupBy("label", "gene").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: F.when(F.round(f"s_{c}", 12) > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in columns}
    return d.join(F.broadcast(m), ["label", "gene"]).withColumns(scaled).select(*d.columns)


def _sums(d: DataFrame, sym: DataFrame, columns: list[str]) -> DataFrame:
    """``gene, n, w`` and, for each pair of columns, the sums of products over neighbours (``e_``) and over points (``p_``)."""
    two = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    e = pairs(d, sym, *columns).groupBy("gene").agg(F.count("*").alias("w"), *[F.sum(F.col(a) * F.col(b + "j")).alias(f"e_{a}{b}") for a, b in two])
    return d.groupBy("gene").agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}{b}") for a, b in two]).join(e, "gene")


def _autocorrelation(over_edges: Column, over_points: Column) -> Column:
    return F.coalesce(F.try_divide(F.col("n") * over_edges, F.col("w") * over_points), F.lit(0.0))


def make_twin(v: DataFrame, labels: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """``i, gene, v`` of the twin of ``v(i, gene, v)`` with the domains ``labels(i, label)``, which are the twin's truth."""
    sym = saved(symmetric(edges), "twin_edges")
    d = v.join(labels, "i").select("i", "gene", "label", "v", noise(seed, "i", "gene").alias("u"))
    d = saved(d, "twin_noise")
    near = pairs(d, sym.unionByName(labels.select("i", F.col("i").alias("j"))), "u", "v").groupBy("i", "gene").agg(F.avg("uj").alias("s"), F.first("u").alias("u"), F.first("v").alias("v"))
    near = saved(near.join(labels, "i").select("i", "gene", "label", "v", F.col("v").alias("r"), "u", "s"), "twin_smoothed")
    field = saved(standardized(near, ["r", "u", "s"]), "twin_field")
    found = _sums(field.select("i", "gene", "r", "u", "s"), sym, ["r", "u", "s"])
    apart = []
    for t in TRIALS:
        a, b = math.sqrt(1 - t), math.sqrt(t)
        mixed = _autocorrelation(a * a * F.col("e_uu") + 2 * a * b * F.col("e_us") + b * b * F.col("e_ss"), a * a * F.col("p_uu") + 2 * a * b * F.col("p_us") + b * b * F.col("p_ss"))
        apart.append(F.struct(F.round(F.abs(mixed - _autocorrelation(F.col("e_rr"), F.col("p_rr"))), 9).alias("gap"), F.lit(t).alias("share")))
    share = found.select("gene", F.array_min(F.array(*apart))["share"].alias("share"))
    new = field.join(F.broadcast(saved(share, "shares")), "gene").select("i", "gene", "label", "v", (F.sqrt(1 - F.col("share")) * F.col("u") + F.sqrt("share") * F.col("s")).alias("f"))
    new = standardized(saved(new, "twin_mixed"), ["f"])
    cell = v.join(labels, "i").groupBy("label", "gene").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return new.join(F.broadcast(cell), ["label", "gene"]).select("i", "gene", (F.col("m") + F.col("sd") * F.col("f")).alias("v"))


def gene_features(v: DataFrame, edges: DataFrame) -> DataFrame:
    """``gene, mean, sd, autocorrelation``."""
    m = v.groupBy("gene").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    centred = v.join(F.broadcast(m), "gene").select("i", "gene", (F.col("v") - F.col("mean")).alias("c"))
    a = _sums(centred, symmetric(edges), ["c"]).select("gene", _autocorrelation(F.col("e_cc"), F.col("p_cc")).alias("autocorrelation"))
    return m.join(a, "gene")


def match_report(real: DataFrame, twin: DataFrame) -> DataFrame:
    """One row over the genes of two ``gene_features``: ``features, match_l2, match_cosine`` and the greatest differences. Distances
    are relative to the sample's own size, 0.001 at least."""
    a, b = (d.select("gene", F.expr("stack(3, 'mean', mean, 'sd', sd, 'autocorrelation', autocorrelation) as (feature, value)")) for d in (real, twin))
    j = a.join(b.withColumnRenamed("value", "twin"), ["gene", "feature"])
    off = (F.col("twin") - F.col("value")) / F.greatest(F.abs("value"), F.lit(1e-3))
    gap = lambda f: F.max(F.when(F.col("feature") == f, F.abs(F.col("twin") - F.col("value")))).alias(f"greatest_{f}_gap")
    return j.agg(F.count("*").alias("features"), F.sqrt(F.avg(off * off)).alias("match_l2"), F.try_divide(F.sum(F.col("twin") * F.col("value")), F.sqrt(F.sum(F.col("twin") * F.col("twin")) * F.sum(F.col("value") * F.col("value")))).alias("match_cosine"), *[gap(f) for f in ("mean", "sd", "autocorrelation")])
