"""Registered queries of studies over evidence and of name rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as N
from ..operators import domains as D
from ..operators import graph
from ..operators import studies as S
from . import adapters as A
from .adapters import with_
from .queries_evidence import MEANS, means
from .queries_matrix import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Names as they are written, with the task and the platform that the definition gives them.
KINDS = (
    ("Domain_Detection", "spatial_domain", "domaindetection"), (" domain ", "spatial_domain", "domain"), ("H&E2ST", "virtual_st", "h&e2st"), ("virtual_stain", "virtual_st", "virtualstain"), ("SVG", "svg", "svg"),
    ("Visium-HD", "visium-hd", "visium_hd"), ("10x_Visium", "10x_visium", "visium"), ("MERSCOPE", "merscope", "merscope"), ("Vizgen", "vizgen", "merfish"), ("Slide-seqV2", "slide-seqv2", "slideseq"),
    ("scATAC", "scatac", "chromatin"), ("", None, None), ("unheard of", "unheard of", "unheard of"),
)


def _of_kind(column: str, at: int) -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    return f"CASE {column} % {len(KINDS)} " + " ".join(f"WHEN {n} THEN {quoted(k[at])}" for n, k in enumerate(KINDS)) + " END"


@entry("name_rules", f"SELECT p_partkey AS k, p_name AS method, p_type || '@' || p_brand AS policy, {_of_kind('p_partkey', 1)} AS task, {_of_kind('p_partkey', 2)} AS platform, regexp_replace(p_name || '@' || p_type || '@' || p_brand, '[^A-Za-z0-9_.-]', '_', 'g') AS key FROM part")
def name_rules(s, d):
    p = A.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("@", "p_name", "p_type", "p_brand").alias("name"), F.expr(_of_kind("p_partkey", 0)).alias("kind"))
    return p.select("k", N.method_of(F.col("name")).alias("method"), N.policy_of(F.col("name")).alias("policy"), N.normalized_task(F.col("kind")).alias("task"), N.platform(F.col("kind")).alias("platform"), N.sanitized(F.col("name")).alias("key"))


#: Records, and the keys and long lists that the definition refuses in them.
RECORDS = (
    ('{"score": 0.5, "meta": {"platform": "visium", "tissue": "brain"}}', "", False), ('{"records": [{"score": 1, "extra": {"Cell_ID": 7}}]}', "Cell_ID", False),
    ('{"a": {"b": [1, 2, 3, 4, 5, 6, 7, 8, 9]}}', "", True), ('{"a": [1, 2, 3, 4, 5, 6, 7, 8]}', "", False), ('{"X_spatial": [[0, 1]], "obsm.raw": 1, "n": "counts"}', "X_spatial", False),
    ('{"note": "the \\"matrix\\": [1,2,3,4,5,6,7,8,9,10]", "layers[0]": null}', "layers[0]", False), ('{"study.counts_total": 3, "counts.study": 4}', "study.counts_total", False),
    ('{"rows": [true, 1, 2.5, -3e2, 0, 0, 0, 0, false]}', "", True), ('{"rows": ["1", 2, 3, 4, 5, 6, 7, 8, 9]}', "", False), ("{}", "", False),
)


@entry("privacy_gate", f"SELECT event_id, CASE event_id % {len(RECORDS)} " + " ".join(f"WHEN {n} THEN '{r[1]}'" for n, r in enumerate(RECORDS)) + " END AS private, " + f"event_id % {len(RECORDS)} IN (" + ", ".join(str(n) for n, r in enumerate(RECORDS) if r[2]) + ") AS long_numbers FROM events")
def privacy_gate(s, d):
    """Records of several kinds, one for each event, under the gate."""
    record = F.element_at(F.array(*[F.lit(r[0]) for r in RECORDS]), (F.col("event_id") % len(RECORDS) + 1).cast("int"))
    return A.table(s, d, "events").withColumn("record", record).select("event_id", F.array_join(N.private_keys(F.col("record")), ",").alias("private"), N.long_numbers(F.col("record")).alias("long_numbers"))


@entry("oracle_leakage", with_("perf", "p AS (SELECT config, avg(score) FILTER (WHERE status = 'N') AS oracle, avg(score) FILTER (WHERE status <> 'N') AS estimate FROM perf GROUP BY 1)") + "SELECT config, round(oracle, 6) AS oracle, round(estimate, 6) AS estimate, round(oracle - estimate, 6) AS drop, round(CASE WHEN oracle > 0 THEN estimate / oracle END, 6) AS recovery FROM p")
def oracle_leakage(s, d):
    p = A.perf(s, d).withColumn("mode", F.when(F.col("status") == "N", "oracle").otherwise("estimate"))
    return rounded(S.oracle_leakage(p), "oracle", "estimate", "drop", "recovery")


@entry("resource_budget_winners", with_("perf", "m AS (SELECT dataset, config, avg(score) FILTER (WHERE secs <= 20) AS score, count(*) FILTER (WHERE secs > 20) AS rej FROM perf GROUP BY 1, 2)", "r AS (SELECT *, sum(rej) OVER (PARTITION BY dataset) AS rejected FROM m)") + "SELECT dataset, config, round(score, 6) AS score, CAST(rejected AS BIGINT) AS rejected FROM r WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(score, 9) DESC, config) = 1")
def resource_budget_winners(s, d):
    return rounded(S.under_budget(A.perf(s, d), 20.0), "score")


@entry("factor_effect", with_("perf", "h AS (SELECT *, secs > (SELECT quantile_cont(secs, 0.5) FROM perf) AS high FROM perf)", "m AS (SELECT config, dataset, avg(score) FILTER (WHERE high) AS hi, avg(score) FILTER (WHERE NOT high) AS lo FROM h GROUP BY 1, 2)") + "SELECT config, round(avg(hi - lo), 6) AS effect, round(stddev_samp(hi - lo), 6) AS sd, count(*) AS n FROM m WHERE hi IS NOT NULL AND lo IS NOT NULL GROUP BY 1")
def factor_effect(s, d):
    return rounded(S.effect(A.perf(s, d), "secs"), "effect", "sd")


@entry("run_coverage", with_("perf") + "SELECT config, count(*) AS runs, count(*) FILTER (WHERE lower(status) <> 'r') AS ok, round(count(*) FILTER (WHERE lower(status) <> 'r') / count(*)::DOUBLE, 6) AS share FROM perf GROUP BY 1")
def run_coverage(s, d):
    return rounded(S.coverage(A.perf(s, d), ("r",)), "share")


STUDY = "st AS (SELECT n_name AS dataset, r_name AS study FROM nation JOIN region ON n_regionkey = r_regionkey)"


def study(s, d):
    return A.table(s, d, "nation").join(F.broadcast(A.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("study"))


@entry("study_grouped_means", with_("perf", MEANS, STUDY, "u AS (SELECT study, config, avg(score) AS score FROM means JOIN st USING (dataset) GROUP BY 1, 2)") + "SELECT config, round(avg(score), 6) AS score, count(*) AS studies FROM u GROUP BY 1")
def study_grouped_means(s, d):
    return rounded(S.by_study(means(s, d), study(s, d)), "score")


@entry("leave_one_study_out", with_("perf", MEANS, STUDY, "u AS (SELECT study, config, avg(score) AS score FROM means JOIN st USING (dataset) GROUP BY 1, 2)", "t AS (SELECT *, (sum(score) OVER c - score) / (count(*) OVER c - 1) AS train, max(score) OVER (PARTITION BY study) AS oracle FROM u WINDOW c AS (PARTITION BY config))") + "SELECT study, config, round(oracle - score, 6) AS regret FROM t WHERE isfinite(train) QUALIFY row_number() OVER (PARTITION BY study ORDER BY round(train, 9) DESC, config) = 1")
def leave_one_study_out(s, d):
    return rounded(S.hold_out_studies(means(s, d), study(s, d)), "regret")


@entry("pareto_stability", with_("perf", "d AS (SELECT b, config, score, secs, ascii(left(md5(b || ':' || dataset), 1)) % 4 AS t FROM perf, (SELECT unnest(range(1, 17)) AS b))", "o AS (SELECT b, config, round(CASE WHEN sum(t) > 0 THEN sum(t * score) / sum(t) ELSE 0 END, 9) AS accuracy, round(CASE WHEN sum(t) > 0 THEN sum(t * secs) / sum(t) ELSE 0 END, 9) AS speed FROM d GROUP BY 1, 2)",
"e AS (SELECT *, (max(accuracy) OVER w - min(accuracy) OVER w) * 1e-3 AS ea, (max(speed) OVER w - min(speed) OVER w) * 1e-3 AS es FROM o WINDOW w AS (PARTITION BY b))", "f AS (SELECT config FROM e l WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.b = l.b AND r.config <> l.config AND NOT (r.accuracy < l.accuracy - l.ea OR r.speed > l.speed + l.es) AND (r.accuracy > l.accuracy + l.ea OR r.speed < l.speed - l.es)))") + "SELECT config, round(count(*) / 16.0::DOUBLE, 6) AS inclusion, count(*) / 16.0 >= 0.5 AS stable FROM f GROUP BY 1")
def pareto_stability(s, d):
    return rounded(S.pareto_stability(A.perf(s, d), {"accuracy": "max", "speed": "min"}), "inclusion")


@entry("donor_weighted_mean", with_("perf", "d AS (SELECT dataset, sum(score * secs) / sum(secs) AS m, sum(secs) * sum(secs) / sum(secs * secs) AS n FROM perf GROUP BY 1)") + "SELECT round(avg(m), 6) AS mean, round(avg(n), 4) AS effective_n, count(*) AS donors FROM d")
def donor_weighted_mean(s, d):
    p = A.perf(s, d).select(F.col("dataset").alias("donor"), F.col("score").alias("value"), F.col("secs").alias("weight"))
    return rounded(rounded(S.weighted_by_donor(p), "mean"), "effective_n", dp=4)


@entry("cumulative_share_threshold", with_("expr", "g AS (SELECT gene_id, sum(value) AS s FROM expr GROUP BY 1)", "c AS (SELECT sum(s) OVER (ORDER BY s DESC, gene_id ROWS UNBOUNDED PRECEDING) AS c, sum(s) OVER () AS t, row_number() OVER (ORDER BY s DESC, gene_id) AS r FROM g)") + "SELECT CAST(min(r) AS INTEGER) AS n FROM c WHERE round(c / t, 9) >= 0.9")
def cumulative_share_threshold(s, d):
    g = A.expr(s, d).groupBy("gene_id").agg(F.sum("value").alias("s"))
    return S.cumulative_share(g, "s", "gene_id", 0.9)


@entry("cluster_count_curve")
def cluster_count_curve(s, d):
    """Depends on k-means starts: checked for shape."""
    e = D.embedding(A.values(s, d), graph.knn(A.points(s, d), 6))
    return rounded(S.cluster_count_curve(e, [2, 3, 4]), "ch")
