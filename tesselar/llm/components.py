"""Connected components by alternating large-star and small-star steps, every step a join of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, met_by_weight, stored


def _with_least(neighbours: DataFrame, total: int) -> DataFrame:
    """``(u, v)`` rows with the least of u's neighbours and u itself; minima are aggregated before they are joined, and those
    of a hub, which may have most of the rows, are broadcast."""
    least = stored(neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    return met_by_weight(neighbours, least, "u", "n", total, how="inner")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` have u > v."""
    found = _with_least(edges, total)
    return found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every id that a link names; component is the least id reachable.

    Links are undirected; repeated links and links of an id with itself change nothing, links with a null end are left
    out. Without links the result is empty. The steps end when the edges are stars that no step changes, after a number of
    rounds logarithmic in the longest path.
    """
    edges = stored(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    told = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = told(edges)
    while was[0]:
        large = stored(_large_star(edges, was[0]), "edges")
        new = stored(_small_star(large, was[0]), "edges")
        now = told(new)
        dropped(edges.sparkSession, edges, large)
        edges = new
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
