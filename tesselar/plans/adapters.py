"""Views of the driver's tables in this library's schema, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse counts: order by part."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("feature_name"), F.col("p_brand").startswith("Brand#1").alias("mito"), F.col("p_brand").alias("group"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates and labels: the first two dimensions of an embedding."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").cast("int").alias("label"), F.when(e[2] > 0, 2).otherwise(0).alias("_a"), F.when(e[3] > 0, 1).otherwise(0).alias("_b")).select("i", "x", "y", "label", (F.col("_a") + F.col("_b")).alias("pred"))


def values(spark: SparkSession, sf_dir: str, first: int = 3, last: int = 64) -> DataFrame:
    """Dense values of genes: dimensions first to last (counted from 1) of an embedding, all that are not coordinates."""
    picked = F.slice("embedding", first, last - first + 1)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode(picked).alias("g", "v")).select("i", (F.col("g") + first).alias("gene"), F.col("v").cast("double").alias("v"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``values`` without their signs, for methods on expression, which is not negative."""
    return values(spark, sf_dir).withColumn("v", F.abs("v"))


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long benchmark table: nation is the data set, brand the configuration, line number the seed."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.col("n_name").alias("dataset"), F.col("p_brand").alias("config"), F.col("l_linenumber").alias("seed"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("secs"), F.col("l_returnflag").alias("status"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lines: one of seven laboratories reports a score for a data set and a method."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"), (F.col("user_id") % 7).alias("node"), F.col("event_type").alias("dataset"), (F.col("user_id") % 11).alias("method"),
        F.get_json_object("props", "$.k").cast("int").alias("seed"), (F.col("value") / 100.0).alias("score"), F.col("ts").alias("ingested_at"),
    )


SQL = {
    "expr": "expr AS (SELECT l_orderkey AS obs_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)",
    "var": "var AS (SELECT p_partkey AS gene_id, p_name AS feature_name, starts_with(p_brand, 'Brand#1') AS mito, p_brand AS grp FROM part)",
    "pts": "pts AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS INTEGER) AS label, CASE WHEN embedding[3] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[4] > 0 THEN 1 ELSE 0 END AS pred FROM embeddings)",
    "val": "val AS (SELECT vec_id AS i, g AS gene, CAST(embedding[g] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(3, 65)) AS g))",
    "cnt": "cnt AS (SELECT i, gene, abs(v) AS v FROM val)",
    "perf": "perf AS (SELECT n_name AS dataset, p_brand AS config, l_linenumber AS seed, l_discount AS score, l_quantity AS secs, l_returnflag AS status FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)",
    "evid": "evid AS (SELECT event_id AS line_no, user_id % 7 AS node, event_type AS dataset, user_id % 11 AS method, CAST(json_extract_string(props, '$.k') AS INTEGER) AS seed, value / 100.0 AS score, ts AS ingested_at FROM events)",
}


def knn_sql(k: int, name: str = "knn", src: str = "pts", part: str = "") -> str:
    same = f" AND a.{part} = b.{part}" if part else ""
    return f"{name} AS (SELECT a.i AS i, b.i AS j, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2, row_number() OVER (PARTITION BY a.i ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.i) AS r FROM {src} a JOIN {src} b ON a.i <> b.i{same} QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.i) <= {k})"


def with_(*parts: str) -> str:
    """``WITH`` over named adapters (keys of ``SQL``) and further expressions."""
    return "WITH " + ",\n".join(SQL.get(p, p) for p in parts) + "\n"
