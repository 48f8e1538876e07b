"""Registered queries of polygons read from GeoJSON, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regions
from ..sources.geojson import read_geojson
from . import adapters as A
from .adapters import with_
from .tables import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _features(s: SparkSession, d: str) -> DataFrame:
    """Around the middle of each label's points a square with a square hole, and a second, smaller square beside it."""
    c = A.points(s, d).groupBy("label").agg(F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y"))
    at = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    square = lambda h, off=0.0: F.array(at(off - h, -h), at(off + h, -h), at(off + h, h), at(off - h, h), at(off - h, -h))
    h = 0.1 + 0.02 * F.col("label")
    parts = F.array(F.array(square(h), square(F.lit(0.04))), F.array(square(F.lit(0.03), 0.3)))
    named = F.when(F.col("label") % 2 == 0, F.struct(F.struct(F.concat(F.lit("region "), "label").alias("name")).alias("classification"), F.lit(None).cast("string").alias("name"))).otherwise(F.struct(F.lit(None).cast("struct<name:string>").alias("classification"), F.concat(F.lit("region "), "label").alias("name")))
    f = c.select("label", F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias("geometry"), named.alias("properties")).alias("f"))
    whole = f.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "f"))), lambda x: x["f"]).alias("features"))  # a row for each label
    path = f"{shared_dir(s)}/tesselar/geojson-{uuid.uuid4().hex}"
    whole.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).coalesce(1).write.text(path)
    return read_geojson(s, path)


HITS = """ce AS (SELECT label, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy, 0.1 + 0.02 * label AS h FROM pts GROUP BY 1),
hi AS (SELECT i, ce.label, 4 * h * h - 0.0064 + 0.0036 AS area FROM pts, ce WHERE (x >= cx - h AND x < cx + h AND y >= cy - h AND y < cy + h AND NOT (x >= cx - 0.04 AND x < cx + 0.04 AND y >= cy - 0.04 AND y < cy + 0.04)) <> (x >= cx + 0.27 AND x < cx + 0.33 AND y >= cy - 0.03 AND y < cy + 0.03))"""


@entry("pathology_domains", with_("pts", HITS) + "SELECT pts.i, 'region ' || arg_min(hi.label, (area, hi.label)) AS label FROM pts LEFT JOIN hi USING (i) GROUP BY 1")
def pathology_domains(s, d):
    return regions.assign(A.points(s, d), _features(s, d))


@entry("pathology_conflicts", with_("pts", HITS) + "SELECT pts.i, CASE WHEN count(hi.label) > 0 THEN CASE WHEN min(hi.label) = max(hi.label) THEN 'region ' || min(hi.label) ELSE 'ambiguous' END END AS label FROM pts LEFT JOIN hi USING (i) GROUP BY 1")
def pathology_conflicts(s, d):
    """Smaller polygons are not preferred: points that several labels claim are ambiguous."""
    return regions.assign(A.points(s, d), _features(s, d), prefer_smaller=False)
