"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_sql
from .exact import exact_dedup
from .lines import drop_repeated_lines
from .neardup import near_duplicates
from .packing import Limits, pack
from .pieces import encode_pieces
from .pii import KINDS, find_pii
from .quality import fit_quality, score_fitted
from .repair import repair
from .suffix_array import remove_repeats
from .suffix_tree import fit_and_score
from .topk import top_k
from .trie import prefix_trie
from .wrappers import extract


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the same on every machine that has the library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_hamming_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trained = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if trained.model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("content_score"), none.alias("metadata_score"), none.alias("score"), F.lit(True).alias("kept"), *[F.lit(0).cast("long").alias(c) for c in ("rounds", "labels_by_content", "labels_by_metadata")])
    counts = {"rounds": trained.model.rounds, "labels_by_content": trained.model.handed[0], "labels_by_metadata": trained.model.handed[1]}
    return score_fitted(trained).select("doc_id", F.col("content").alias("content_score"), F.col("metadata").alias("metadata_score"), "score", F.col("keep").alias("kept"), *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), Limits(tokens=1024, segments=256, loss_tokens=1024), cut=True, end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_pieces(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    base = [k.name for k in KINDS if k.always]
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(text(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op11_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_vector_packing": op2_vector_packing,
    "op3_hamming_neardup": op3_hamming_neardup,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_line_dedup": op5_line_dedup,
    "op6_piece_encoding": op6_piece_encoding,
    "op7_suffix_array": op7_suffix_array,
    "op8_pii": op8_pii,
    "op9_block_topk": op9_block_topk,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_wrapper_extraction": op11_wrapper_extraction,
    "op12_structure_repair": op12_structure_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op12_structure_repair": conversation_sql.REPAIR,
    "op13_prefix_trie": conversation_sql.TRIE,
    "op3_hamming_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS i, b AS j FROM l UNION SELECT b, a FROM l),
walk AS (SELECT i, i AS c FROM e UNION SELECT e.j, k.c FROM walk k JOIN e ON k.i = e.i WHERE k.c < e.j),
g AS (SELECT i, min(c) AS c FROM walk GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(g.c, d.doc_id) AS component_id, coalesce(g.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN g ON d.doc_id = g.i""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE c.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY doc_id""",
    "op9_block_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
}
