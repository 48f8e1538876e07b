"""Bundles: a folder of Parquet tables with a manifest, which is written last and so marks the bundle complete."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]*")


def safe_name(name: str) -> str:
    """Names that can't leave the bundle's folder."""
    if not _NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"not a table name: {name!r}")
    return name


def sanitized(key: str) -> str:
    """A key with every sign but letters, digits, ``_``, ``.`` and ``-`` made ``_``."""
    return re.sub(r"[^A-Za-z0-9_.-]", "_", key)


def _digest(spark: SparkSession, path: str) -> str:
    """Of a table's files in any order of reading: files are hashed where they lie, their names don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256).alias("h"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]


def write_bundle(tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> dict:
    """Write every table, then the manifest, beside the bundle's place, and move the whole there: a reader finds all or nothing.

    Nothing that exists is overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there, made = hadoop.Path(path), f"{path.rstrip('/')}.{uuid.uuid4().hex}.writing"
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(there):
        raise FileExistsError(path)
    try:
        found = {}
        for name, df in tables.items():
            df.write.parquet(f"{made}/{safe_name(name)}")
            back = spark.read.parquet(f"{made}/{name}")
            found[name] = {"sha256": _digest(spark, f"{made}/{name}"), "rows": back.count(), "schema": back.schema.jsonValue()}
        manifest = {"version": 1, "tables": found, "meta": meta or {}}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{made}/{MANIFEST}")
        if fs.exists(there) or not fs.rename(hadoop.Path(made), there):
            raise FileExistsError(path)
    finally:
        fs.delete(hadoop.Path(made), True)
    return manifest


def inspect_bundle(spark: SparkSession, path: str) -> dict:
    """The manifest alone."""
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def read_bundle(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    out = {}
    for name, about in inspect_bundle(spark, path)["tables"].items():
        where = f"{path}/{safe_name(name)}"
        if verify and _digest(spark, where) != about["sha256"]:
            raise ValueError(f"table {name} is not what was written")
        out[name] = spark.read.parquet(where)
    return out
