"""An append-only store of evidence: records by content hash, corrections of their status, the latest line of each record.

The store is a Parquet folder partitioned by the hash of a record's key, so a batch of records, or of corrections, reads
only the buckets that it touches, whatever the store has grown to. A record is never changed: a correction is a new line
with the same content hash, and the line ingested last stands for the record. What was written once is not written again,
so a batch may be replayed, also one that was half written. A batch leaves one file in a bucket, more only where it is large.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a store; a batch's buckets are listed on the driver.
BUCKETS = 64
#: Hexadecimal digits by which the digests of a bundle's records are dealt.
PREFIX = 3
#: What a record's evidence may be; fixed values.
STATES = ("verified", "unverified", "disputed")
#: A logical record, and a line of its history.
KEY = ["content_hash", "dataset", "method", "seed"]
LINE = [*KEY, "verification_status", "ingested_at"]
#: Columns that are no content of a bundle.
UNSIGNED = ("content_hash", "signature", "verification_status", "ingested_at", "provenance", "bucket")


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def read(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """All lines; where there is no store yet, none, with the columns of ``like``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if like is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0)


def append_new(batch: DataFrame, path: str, keys: list[str], order: str = "line_no", states: bool = False) -> int:
    """Append the rows whose key the store lacks, the first of each key by ``order``; how many. ``batch`` is read once. With
    ``states``, a status that is none of ``STATES`` is an error, whichever row has it: such rows come first of their key."""
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", _bucket(keys))
    by = [F.coalesce(F.col("verification_status").isin(*STATES), F.lit(False)), order] if states else [order]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n").persist()
    try:
        touched = [r[0] for r in first.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        if states:
            checked(first)
        have = read(spark, path, rows).filter(F.col("bucket").isin(touched)).select(*keys).distinct()
        same = None
        for k in keys:
            one = first[k].eqNullSafe(have[k])
            same = one if same is None else same & one
        new = first.join(have, same, "left_anti").persist()
        try:
            n = new.count()
            if n:
                new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
            return n
        finally:
            new.unpersist()
    finally:
        first.unpersist()


def with_content_hash(records: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """Records with the SHA-256 of their bundle: of its records' own digests in order, those that begin alike (``PREFIX`` digits)
    hashed first and their hashes then, so that no task holds a bundle. What is said of a record later (status, provenance)
    is no part of it, and neither the order of columns nor that of rows matters."""
    names = sorted(c for c in records.columns if c not in UNSIGNED)
    own = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = records.select(bundle, own.alias("_d")).groupBy(bundle, F.substring("_d", 1, PREFIX).alias("_p")).agg(joined("_d").alias("_d"))
    whole = parts.groupBy(bundle).agg(joined(F.concat("_p", F.lit(":"), "_d")).alias("content_hash"))  # 16 ** PREFIX parts at most
    return records.drop("content_hash").join(whole, bundle)


def checked(records: DataFrame) -> DataFrame:
    """``records``, in which a status that is none of ``STATES`` is an error."""
    bad = records.filter(~F.col("verification_status").isin(*STATES) | F.col("verification_status").isNull()).select("verification_status").first()
    if bad is not None:
        raise ValueError(f"unknown verification status {bad[0]!r}; one of {STATES}")
    return records


def append_bundles(records: DataFrame, path: str) -> int:
    """Append records with a content hash, each once: a bundle that comes again adds nothing, a reproduction by others is new."""
    return append_new(records, path, KEY, states=True)


def append_corrections(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """Append a line for each record of the store whose status changes: ``changes`` has its key, ``verification_status``, ``reason``
    and ``ingested_at``. The line repeats the record's latest one; a change that was appended before adds nothing."""
    changes = checked(changes).withColumn("bucket", _bucket(KEY))
    touched = [r[0] for r in changes.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    own = latest(spark.read.parquet(path).filter(F.col("bucket").isin(touched)))
    new = changes.select(*KEY, F.col("verification_status").alias("_to"), F.col("ingested_at").alias("_at"), "reason")
    lines = own.join(new, KEY).withColumn("provenance", F.map_concat(F.coalesce("provenance", F.create_map().cast("map<string,string>")), F.create_map(F.concat(F.lit("status_change at "), F.col("_at").cast("string")), F.concat_ws(": ", "_to", "reason"))))
    lines = lines.withColumns({"verification_status": F.col("_to"), "ingested_at": F.col("_at")}).drop("_to", "_at", "reason")
    # A line's own place is its bucket by the record's key, so that all lines of a record lie together.
    have = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).select(*LINE).distinct()
    fresh = lines.join(have, LINE, "left_anti").persist()
    try:
        n = fresh.count()
        if n:
            fresh.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
        return n
    finally:
        fresh.unpersist()


def latest(lines: DataFrame) -> DataFrame:
    """The line of each record that was ingested last; of lines of one time the one furthest from the first status."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ingested_at"), F.desc(F.size(F.coalesce("provenance", F.create_map().cast("map<string,string>")))), "verification_status")
    return lines.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ingest_bundles(spark: SparkSession, feed: str, path: str, schema: str):
    """Append bundles from JSON feeds as they come. Returns the query."""
    lines = spark.readStream.schema(schema).json(feed)
    return lines.writeStream.foreachBatch(lambda batch, _: append_bundles(batch, path)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
