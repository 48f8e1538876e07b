"""The evidence store: replays, reproductions, corrections, and what a batch reads."""

import pytest
from pyspark.sql import functions as F

from tesselar.streaming import store as S

SCHEMA = "line_no long, bundle_id string, node int, dataset string, method string, seed int, score double, verification_status string, ingested_at timestamp, provenance map<string,string>"


def records(spark, rows, bundle="b", node=1, status="unverified"):
    return spark.createDataFrame([(k, bundle, node, d, m, s, x, status, None, None) for k, (d, m, s, x) in enumerate(rows)], SCHEMA).withColumn("ingested_at", F.timestamp_seconds(F.lit(1000)))


ROWS = [("d", "m", 0, 0.5), ("d", "m", 1, 0.6), ("d", "n", 0, None), ("e", None, None, 0.1)]


def test_content_hash(spark):
    h = lambda df: {r.content_hash for r in S.with_content_hash(df).collect()}
    one = h(records(spark, ROWS))
    same = records(spark, ROWS).select("score", "line_no", "bundle_id", "node", "dataset", "seed", "method", F.lit("verified").alias("verification_status"), F.current_timestamp().alias("ingested_at")).orderBy(F.rand())
    assert len(one) == 1 and h(same) == one != h(records(spark, ROWS[:3])) != h(records(spark, [*ROWS[:3], ("e", None, None, 0.2)]))


def test_bundles_come_once(spark, tmp_path):
    path = str(tmp_path / "s")
    b = S.with_content_hash(records(spark, ROWS + ROWS[:1]))
    assert S.append_bundles(b, path) == 4 and S.append_bundles(b, path) == 0
    assert S.append_bundles(S.with_content_hash(records(spark, ROWS, "c", 2)), path) == 4
    assert spark.read.parquet(path).count() == 8
    with pytest.raises(ValueError, match="rejected"):
        S.append_bundles(b.withColumn("verification_status", F.lit("rejected")), path)


def test_corrections(spark, tmp_path):
    path = str(tmp_path / "s")
    b = S.with_content_hash(records(spark, ROWS))
    S.append_bundles(b, path)
    change = lambda status, at: b.filter("seed = 0 and method = 'm'").select(*S.KEY, F.lit(status).alias("verification_status"), F.lit("seen again").alias("reason"), F.timestamp_seconds(F.lit(at)).alias("ingested_at"))
    assert S.append_corrections(spark, path, change("verified", 2000)) == 1 and S.append_corrections(spark, path, change("verified", 2000)) == 0
    assert S.append_corrections(spark, path, change("disputed", 3000)) == 1
    lines = spark.read.parquet(path)
    now = {(r.method, r.seed): (r.verification_status, r.score, len(r.provenance or {})) for r in S.latest(lines).collect()}
    assert lines.count() == 6 and now == {("m", 0): ("disputed", 0.5, 2), ("m", 1): ("unverified", 0.6, 0), ("n", 0): ("unverified", None, 0), (None, None): ("unverified", 0.1, 0)}
    assert S.append_bundles(b, path) == 0
    stray = change("verified", 9).withColumn("content_hash", F.lit("unheard of"))
    assert S.append_corrections(spark, path, stray) == 0
    with pytest.raises(ValueError):
        S.append_corrections(spark, path, change("gone", 1))


def test_a_batch_reads_its_buckets_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    S.append_bundles(S.with_content_hash(records(spark, [("d", "m", i, 0.1) for i in range(300)])), path)
    seen = []
    read = S.read
    monkeypatch.setattr(S, "read", lambda *a: seen.append(read(*a)) or seen[-1])
    one = S.with_content_hash(records(spark, ROWS[:1], "other"))
    bucket = one.select(S._bucket(S.KEY)).first()[0]
    S.append_bundles(one, path)
    plan = seen[0].filter(F.col("bucket").isin([bucket]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan and len({r.bucket for r in spark.read.parquet(path).select("bucket").distinct().collect()}) > 50


def test_stream_and_half_written_batch(spark, tmp_path):
    b = S.with_content_hash(records(spark, ROWS)).drop("provenance")
    path = str(tmp_path / "s")
    S.append_bundles(b.limit(2), path)  # what a batch that died had written
    b.write.json(str(tmp_path / "feed"))
    S.ingest_bundles(spark, str(tmp_path / "feed"), path, b._jdf.schema().toDDL()).awaitTermination()
    assert spark.read.parquet(path).count() == 4


def test_bundles_are_hashed_by_parts_and_read_once(spark, tmp_path):
    b = records(spark, [("d", "m", i, 0.1) for i in range(40)])
    plan = S.with_content_hash(b)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(" in plan  # a bundle's digests are dealt before they are gathered
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "string").asNondeterministic()
    batch = S.with_content_hash(b).withColumn("method", seen("method"))
    assert S.append_bundles(batch, str(tmp_path / "s")) == 40 and read.value == 40
    files = [f.parent.name for f in (tmp_path / "s").rglob("*.parquet")]
    assert len(files) == len(set(files))  # one in a bucket
    late = S.with_content_hash(records(spark, ROWS[:1])).unionByName(S.with_content_hash(records(spark, ROWS[:1], status="rejected")).withColumn("line_no", F.lit(9).cast("long")))
    with pytest.raises(ValueError, match="rejected"):
        S.append_bundles(late, str(tmp_path / "s"))
