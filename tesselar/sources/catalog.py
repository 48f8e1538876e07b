"""A catalogue of data sets as a table: filtered by plain predicates, extended by appending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, task string, assay string, tissue string, has_truth boolean, n_obs long, path string"


def catalogue(spark: SparkSession, rows: list[tuple] | None = None, path: str | None = None) -> DataFrame:
    """Rows given, or a JSON-lines file."""
    return spark.read.schema(SCHEMA).json(path) if path else spark.createDataFrame(rows or [], SCHEMA)


def list_datasets(cat: DataFrame, task: str | None = None, assay: str | None = None, tissue: str | None = None, has_truth: bool | None = None, max_obs: int | None = None) -> DataFrame:
    """Rows that fit all that is asked; names are compared without case."""
    for column, want in (("task", task), ("assay", assay), ("tissue", tissue)):
        if want is not None:
            cat = cat.filter(F.lower(column) == want.lower())
    if has_truth is not None:
        cat = cat.filter(F.col("has_truth") == has_truth)
    return cat if max_obs is None else cat.filter(F.col("n_obs") <= max_obs)


def summary(cat: DataFrame) -> DataFrame:
    return cat.groupBy("task", "assay").agg(F.count("*").alias("datasets"), F.count_if("has_truth").alias("with_truth"), F.sum("n_obs").alias("n_obs"))


def get_dataset(spark: SparkSession, cat: DataFrame, name: str) -> DataFrame:
    found = cat.filter(F.col("name") == name).select("path").limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{len(found)} data sets are named {name!r}")
    return spark.read.parquet(found[0].path)
