"""Polygons of GeoJSON feature collections, as annotation tools export them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a feature's label is looked for, in this order, behind a property that is asked for; fixed values.
LABELS = ("classification.name", "name", "label", "type")
_RING = "array<array<array<double>>>"


def feature_label(properties: Column, label_property: str | None = None) -> Column:
    """The first of the properties (dotted paths) that is there and not blank."""
    names = dict.fromkeys([*([label_property] if label_property else []), *LABELS])
    found = [F.get_json_object(properties, "$." + n) for n in names]
    return F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in found])


def read_geojson(spark: SparkSession, path: str, label_property: str | None = None) -> DataFrame:
    """``poly, label, parts`` of every Polygon and MultiPolygon with a label, with file and place as ``poly``, which orders them: a part is its outer ring with the
    holes behind it. Other geometries are left out. A file is one document; a folder's files are read by many tasks."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: string>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))
    f = raw.select("file", F.posexplode("features").alias("at", "f")).select("file", "at", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"), feature_label(F.col("f.properties"), label_property).alias("label"))
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", _RING))).when(F.col("type") == "MultiPolygon", F.from_json("c", f"array<{_RING}>"))
    points = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
    return f.select(F.struct("file", "at").alias("poly"), "label", points.alias("parts")).filter("label is not null and parts is not null")
