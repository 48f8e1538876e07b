"""The knowledge base a recommender starts from: scores, features, timings and what is known of each data set.

It is written as a folder with one JSON line for each data set and a header of one line, so that it grows with its data sets
and is read by many tasks. A single document with maps by data set, in any of the versions so far, is read as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 3
#: Versions of the document that are understood, and names that stand for the task of domains; fixed values.
VERSIONS = (1, 2, 3)
DOMAINS = ("domain_detection", "domain")
TASK = "spatial_domain"
_ROWS = "dataset string, performance map<string,double>, features array<double>, timings map<string,double>, meta map<string,string>"
_DOCUMENT = (
    "schema_version int, task string, metric string, higher_is_better boolean, feature_order array<string>, performance map<string,map<string,double>>, features map<string,array<double>>, "
    "timings map<string,map<string,double>>, dataset_meta map<string,map<string,string>>"
)
_HEADER = "schema_version int, task string, metric string, higher_is_better boolean, feature_order array<string>"


@dataclass
class KnowledgeBase:
    """``scores(dataset, config, score, secs)``, ``features(dataset, vec)`` in the order of ``feature_order``, ``meta(dataset, meta)``."""

    scores: DataFrame
    features: DataFrame
    meta: DataFrame
    feature_order: list[str]
    task: str = TASK
    metric: str = "score"
    higher_is_better: bool = True

    def checked(self) -> KnowledgeBase:
        """Itself, if a recommender can work with it: two data sets with features and scores, vectors of the right length, and a
        finite score."""
        both = self.features.join(self.scores.select("dataset").distinct(), "dataset")
        r = both.agg(F.count("*").alias("n"), F.max(F.when(F.size("vec") != len(self.feature_order), F.col("dataset"))).alias("odd")).first()
        if r["n"] < 2:
            raise ValueError("a knowledge base needs two data sets with features and scores")
        if r["odd"] is not None:
            raise ValueError(f"the features of {r['odd']} are not {len(self.feature_order)} numbers")
        if self.scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).isEmpty():
            raise ValueError("a knowledge base needs a finite score")
        return self

    def best(self) -> DataFrame:
        """``dataset, config, score, niche``: the best configuration of each data set and all within 95 % of it."""
        some = self.scores.filter(F.col("score").isNotNull() & ~F.isnan("score")).select("dataset", "config", F.when(F.lit(self.higher_is_better), F.col("score")).otherwise(-F.col("score")).alias("score"))
        first = Window.partitionBy("dataset").orderBy(F.desc(F.round("score", 9)), "config")
        top = some.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
        near = some.join(top.select("dataset", F.col("score").alias("top")), "dataset").filter(F.col("score") >= F.col("top") - 0.05 * F.abs("top"))
        niche = near.groupBy("dataset").agg(F.array_sort(F.collect_set("config")).alias("niche"))
        return top.join(niche, "dataset").withColumn("score", F.when(F.lit(self.higher_is_better), F.col("score")).otherwise(-F.col("score")))


def write(kb: KnowledgeBase, path: str) -> None:
    """Write a knowledge base to a folder that is not there yet."""
    spark = kb.scores.sparkSession
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", finite(c).alias("v")))))
    by = kb.scores.withColumns({"score": F.col("score").cast("double"), "secs": F.col("secs").cast("double")}).groupBy("dataset").agg(entry("score").alias("performance"), entry("secs").alias("timings"))
    rows = by.join(kb.features.withColumnRenamed("vec", "features"), "dataset", "full").join(kb.meta, "dataset", "left")
    rows.select("dataset", "performance", "features", "timings", "meta").write.option("ignoreNullFields", "false").json(f"{path}/datasets")
    spark.createDataFrame([(VERSION, kb.task, kb.metric, kb.higher_is_better, kb.feature_order)], _HEADER).coalesce(1).write.json(f"{path}/header")


def _taken_apart(rows: DataFrame, header) -> KnowledgeBase:
    if header["schema_version"] not in VERSIONS:
        raise ValueError(f"unsupported version of a knowledge base: {header['schema_version']}")
    s = rows.select("dataset", "timings", F.explode("performance").alias("config", "score")).select("dataset", "config", "score", F.try_element_at("timings", F.col("config")).alias("secs"))
    task = header["task"] or TASK
    return KnowledgeBase(
        s, rows.filter("features is not null").select("dataset", F.col("features").alias("vec")), rows.filter("meta is not null").select("dataset", "meta"), list(header["feature_order"] or []),
        TASK if task in DOMAINS else task, header["metric"] or "score", header["higher_is_better"] is not False,
    )


def read(spark: SparkSession, path: str) -> KnowledgeBase:
    """What ``write`` wrote; nulls are scores or features that are not known."""
    header = spark.read.schema(_HEADER).json(f"{path}/header").first()
    return _taken_apart(spark.read.schema(_ROWS).json(f"{path}/datasets"), header).checked()


def read_document(spark: SparkSession, path: str) -> KnowledgeBase:
    """A knowledge base from one JSON document with maps by data set."""
    text = spark.read.text(path, wholetext=True)
    d = text.select(F.from_json("value", _DOCUMENT).alias("d")).select("d.*")
    header = d.select("schema_version", "task", "metric", "higher_is_better", "feature_order").first()
    if header is None or header["schema_version"] is None:
        raise ValueError("a knowledge base is a JSON object with its version")
    names = d.select("*", F.explode(F.array_union(F.coalesce(F.map_keys("performance"), F.array().cast("array<string>")), F.coalesce(F.map_keys("features"), F.array().cast("array<string>")))).alias("dataset"))
    of = lambda c: F.try_element_at(c, F.col("dataset"))
    return _taken_apart(names.select("dataset", of("performance").alias("performance"), of("features").alias("features"), of("timings").alias("timings"), of("dataset_meta").alias("meta")), header).checked()
