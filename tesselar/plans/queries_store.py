"""Registered queries of the evidence store: bundles streamed in, replayed and corrected, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import consensus
from ..streaming import store
from . import adapters as A
from .adapters import with_
from .queries_matrix import rounded
from .tables import saved, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _filled(s: SparkSession, d: str) -> str:
    """A store into which the laboratories' bundles were streamed, in two feeds that repeat each other, and then corrected twice
    by the same changes."""
    base = f"{shared_dir(s)}/tesselar/store-{uuid.uuid4().hex}"
    e = A.evidence(s, d)
    lines = e.select("line_no", F.col("node").cast("string").alias("bundle_id"), "node", "dataset", "method", "seed", "score", F.lit("unverified").alias("verification_status"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), F.lit(None).cast("map<string,string>").alias("provenance"))
    lines = saved(store.with_content_hash(lines), "bundles")
    for _ in range(2):
        lines.write.mode("append").json(f"{base}/feed")
        store.ingest_bundles(s, f"{base}/feed", f"{base}/lines", lines._jdf.schema().toDDL()).awaitTermination()
    late = F.timestamp_seconds(F.lit(4_000_000_000))
    has = store.latest(s.read.parquet(f"{base}/lines"))
    to = lambda some, status, at: has.filter(some).select(*store.KEY, F.lit(status).alias("verification_status"), F.lit("by rule").alias("reason"), at.alias("ingested_at"))
    for _ in range(2):
        store.append_corrections(s, f"{base}/lines", to("seed % 3 = 0", "verified", late))
        store.append_corrections(s, f"{base}/lines", to("node = 2", "disputed", late + F.expr("interval 1 day")))
    return f"{base}/lines"


STORE = """fi AS (SELECT node, dataset, method, seed, score FROM evid QUALIFY row_number() OVER (PARTITION BY node, dataset, method, seed ORDER BY line_no) = 1),
st AS (SELECT *, CASE WHEN node = 2 THEN 'disputed' WHEN seed % 3 = 0 THEN 'verified' ELSE 'unverified' END AS status, 1 + CASE WHEN node = 2 THEN 1 ELSE 0 END + CASE WHEN seed % 3 = 0 THEN 1 ELSE 0 END AS lines FROM fi)"""


@entry("evidence_store", with_("evid", STORE) + "SELECT node, dataset, method, seed, round(score, 6) AS score, status AS verification_status, lines FROM st")
def evidence_store(s, d):
    """The latest line of every record, and how many lines it has."""
    lines = s.read.parquet(_filled(s, d))
    n = lines.groupBy(*[F.col(k).alias("_" + k) for k in store.KEY]).agg(F.count("*").alias("lines"))
    now = store.latest(lines)
    return rounded(now.join(n, [F.col("_" + k).eqNullSafe(F.col(k)) for k in store.KEY]).select("node", "dataset", "method", "seed", "score", "verification_status", "lines"), "score")


@entry("verified_consensus", with_("evid", STORE, "lb AS (SELECT dataset, method, node, avg(score) AS lab, count(*) AS n FROM st WHERE status = 'verified' GROUP BY 1, 2, 3)", "md AS (SELECT dataset, method, median(lab) AS m, count(*) AS labs, sum(n) AS n FROM lb GROUP BY 1, 2)")
  + "SELECT dataset, method, round(m, 9) AS consensus, labs AS n_labs, n AS n_records, CASE WHEN labs < 2 THEN 'unverified' WHEN (SELECT count(*) FROM lb WHERE lb.dataset = md.dataset AND lb.method = md.method AND round(abs(lab - m), 9) <= 0.05) >= 2 THEN 'verified' ELSE 'disputed' END AS status FROM md")
def verified_consensus(s, d):
    """Consensus over the records whose evidence stands."""
    own = store.latest(s.read.parquet(_filled(s, d))).filter("verification_status = 'verified'")
    return rounded(consensus(own).select("dataset", "method", "consensus", "n_labs", "n_records", "status"), "consensus", dp=9)
