"""Long benchmark tables from CSV or JSON: read with a schema, rows without a usable score left out, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import FAILED, FAILED_OR_SKIPPED, usable


def read_long_csv(spark: SparkSession, path: str, statuses: tuple[str, ...] = FAILED) -> DataFrame:
    """``dataset, config, seed, score, secs, status`` from a CSV with a header; missing columns are null."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}

    def col(*options: str):
        return next((F.col(f"`{names[o]}`") for o in options if o in names), F.lit(None).cast("string"))

    score = col("score", "ari").try_cast("double")
    weight = col("spatial_weight")
    config = F.coalesce(col("config"), F.concat_ws("@sw", col("method"), weight), col("method"))
    df = raw.select(col("dataset").alias("dataset"), config.alias("config"), col("seed").try_cast("int").alias("seed"), score.alias("score"), col("secs", "seconds").try_cast("double").alias("secs"), col("status").alias("status"))
    return usable(df, statuses).filter(F.abs("score") < float("inf"))


def memory_by_scale(rows: DataFrame, statuses: tuple[str, ...] = FAILED_OR_SKIPPED) -> DataFrame:
    """``method, memory_gb`` at the largest scale that ran."""
    ok = rows.filter(~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*statuses))
    return ok.groupBy("method").agg(F.max_by("memory_gb", F.struct("n", "memory_gb")).alias("memory_gb"))


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, config, score`` from a JSON document whose ``performance`` maps data sets to maps of scores."""
    kind = "struct<performance:map<string,map<string,double>>>"
    text = spark.read.text(path, wholetext=True)
    perf = text.select(F.from_json("value", kind)["performance"].alias("p")).select(F.explode("p").alias("dataset", "m")).select("dataset", F.explode("m").alias("config", "score"))
    return perf.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def write_knowledge_base(means: DataFrame, path: str) -> None:
    """One JSON line for each data set, so that the writers are as many as the data need."""
    by = means.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", "score")))).alias("performance"))
    by.write.mode("errorifexists").json(path)


def read_knowledge_base_lines(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, config, score`` from what ``write_knowledge_base`` wrote."""
    rows = spark.read.schema("dataset string, performance map<string,double>").json(path)
    return rows.select("dataset", F.explode("performance").alias("config", "score"))
