"""Labels of polygons for points: rings with holes and several parts, many polygons, none of them broadcast.

A polygon is kept in the cells of a grid as wide as itself, at most four of them; a point looks into its cell on every
grid that has polygons. What it meets there is decided by the parity of the polygon's edges to its right, which are kept
by stripes of that grid's height divided by ``STRIPES``, so a point sees the edges of its own stripe alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import saved

STRIPES = 64
AMBIGUOUS = "ambiguous"


def _ring_area(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)) / 2


def polygons(features: DataFrame) -> DataFrame:
    """``poly, label, rings, area`` from ``(poly, label, parts)``, where a part is an outer ring with its holes behind it and a
    ring is an array of (x, y). Features without label or without a ring are left out; ``poly`` gives their order."""
    part = lambda p: _ring_area(p[0]) - F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + _ring_area(r))
    some = features.filter((F.trim("label") != "") & (F.size("parts") > 0)).withColumn("parts", F.filter("parts", lambda p: F.size(p) > 0))
    return some.select("poly", F.trim("label").alias("label"), F.flatten("parts").alias("rings"), F.aggregate("parts", F.lit(0.0), lambda s, p: s + part(p)).alias("area"))


def containing(points: DataFrame, polys: DataFrame) -> DataFrame:
    """``i, poly, label, area``: every polygon that holds a point, by an odd number of edges to the right of it."""
    edge = lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    xs = lambda c: F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c])))
    boxed = polys.select("poly", "label", "area", "rings", F.array_min(xs("x")).alias("x0"), F.array_max(xs("x")).alias("x1"), F.array_min(xs("y")).alias("y0"), F.array_max(xs("y")).alias("y1"))
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-12))
    boxed = saved(boxed.withColumn("level", F.ceil(F.log2(size)).cast("int")), "polygons")
    width = F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    cells = boxed.select("poly", "label", "area", "level", "x0", "x1", "y0", "y1", F.explode(F.sequence(cell("x0"), cell("x1"))).alias("cx"), cell("y0").alias("c0"), cell("y1").alias("c1"))
    cells = cells.withColumn("cy", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")
    levels = [r[0] for r in boxed.select("level").distinct().collect()]  # powers of two between the least and the greatest polygon
    if not levels:
        return points.select("i").limit(0).join(polys.select("poly", "label", "area"), F.lit(False))
    at = points.select("i", "x", "y", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    at = at.select("i", "x", "y", "level", cell("x").alias("cx"), cell("y").alias("cy"))
    near = at.join(cells, ["level", "cx", "cy"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    stripe = lambda y: F.floor(y / (width / STRIPES)).cast("long")
    edges = boxed.select("poly", "level", F.explode(F.flatten(F.transform("rings", edge))).alias("e")).select("poly", "level", "e.*").filter("ay <> by")
    edges = edges.withColumn("stripe", F.explode(F.sequence(stripe(F.least("ay", "by")), stripe(F.greatest("ay", "by"))))).drop("level")
    met = near.select("i", "x", "y", "poly", "label", "area", stripe(F.col("y")).alias("stripe")).join(edges, ["poly", "stripe"])
    straddles = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    right = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    return met.groupBy("i", "poly").agg(F.first("label").alias("label"), F.first("area").alias("area"), F.count_if(straddles & right).alias("n")).filter("n % 2 = 1").drop("n")


def assign(points: DataFrame, features: DataFrame, prefer_smaller: bool = True) -> DataFrame:
    """``i, label`` of every point: of the polygons that hold it the smallest one's, the first among equals; or, if the smaller
    are not preferred, the label all of them share, and ``ambiguous`` where they differ. Null in no polygon.

    Raises where no polygon holds any point, as when coordinates are on another scale.
    """
    hit = saved(containing(points, polygons(features)), "containing")
    if hit.isEmpty():
        raise ValueError("no labelled polygon holds any point; see the label property and the coordinates' scale")
    if prefer_smaller:
        found = hit.groupBy("i").agg(F.min(F.struct("area", "poly", "label")).alias("m")).select("i", F.col("m.label").alias("label"))
    else:
        found = hit.groupBy("i").agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(AMBIGUOUS).alias("label"))
    return points.select("i").join(found, "i", "left")
