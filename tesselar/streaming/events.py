"""Structured Streaming: windows over events, and the append-only evidence log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_dir

from ..operators.evidence import consensus, latest
from .store import append_new


def hourly(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tesselar/stream-{uuid.uuid4().hex}"


def run_hourly(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Hourly windows of a Parquet folder read as a stream until it is used up.

    Windows are appended once the watermark has passed them; what is still open at the end is added from the state's table.
    """
    base = _shared(spark)
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_dir(spark, path) else spark.readStream.schema(schema).parquet(path)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    tumbling = hourly(stream.withWatermark("ts", late))

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    q = tumbling.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def ingest_evidence(spark: SparkSession, feed: str, store: str, schema: str, keys: tuple[str, ...] = ("node", "dataset", "method", "seed")):
    """Append new lines of JSON feeds to a store, each key once however often a feed is read again. Returns the query.

    A batch reads only the buckets of the store that its own keys fall into (see ``store.append_new``).
    """
    lines = spark.readStream.schema(schema).json(feed)
    return lines.writeStream.foreachBatch(lambda batch, _: append_new(batch, store, list(keys))).option("checkpointLocation", f"{store}-state").trigger(availableNow=True).start()


def current_consensus(spark: SparkSession, store: str, tolerance: float = 0.05) -> DataFrame:
    """Consensus over the latest line of each key in the store."""
    return consensus(latest(spark.read.parquet(store), ["node", "dataset", "method", "seed"]), tolerance)
