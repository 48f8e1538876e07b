"""The corpus pipeline: reject, clean, deduplicate, mask and pack ``documents``.

Every stage works on all that its predecessor kept, and hands its rows on as a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import fresh, stored, told_apart
from tesselar.llm.lines import drop_repeated_lines, text_key
from tesselar.llm.neardup import near_duplicates
from tesselar.llm.packing import Limits, pack
from tesselar.llm.pii import mask_pii
from tesselar.llm.quality import fit_quality, forget, score_quality
from tesselar.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; rows keep all their columns.

    Null and empty texts are scored like others; repeated rows are scored each; without labels of both classes all stay.
    """
    trained = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    forget(trained)
    scores = fresh("__quality", docs)
    return score_quality(docs, trained, scores).filter(f"{scores}.keep").drop(scores)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more hold; ``n_chars`` follows the text.

    A text that ten documents or more hold as a whole, but for case and white space at the ends of its lines, would lose
    all its lines to its own copies: the document of the smallest id keeps it, all others lose it. A null text stays null;
    rows that share an id count as one document and lose their own lines each. All other columns stay, whatever their names.
    """
    id_, h1, stays, was, lines, gone = (fresh(x, docs) for x in ("__id", "__h1", "__stays", "__was", "__lines", "__dropped"))
    key = F.xxhash64(text_key(docs["text"]))
    keys = docs.select("doc_id", key.alias(h1), F.xxhash64(F.lit(7), text_key(F.col("text"))).alias("h2")).distinct()
    equal = keys.groupBy(h1, "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias(id_))
    keepers = stored(equal.filter("n >= 10").select(id_, h1), "line_keepers")
    marked = docs.join(keepers, (docs["doc_id"] == keepers[id_]) & (key == keepers[h1]), "left")
    whole = keepers[id_].isNotNull() | docs["text"].isNull()
    before = marked.select(*[docs[c] for c in docs.columns], whole.alias(stays), F.when(whole, docs["text"]).alias(was))
    out = drop_repeated_lines(before, min_docs=10, min_chars=1, counts=(lines, gone))
    changed = (F.col(gone) > 0) & ~F.col(stays)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.when(F.col(stays), F.col(was)).otherwise(F.col("text"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of their five-word shingles; documents without id all stay.

    Texts without words are linked with nothing and stay; of rows that share an id those with equal texts are one document,
    the others are not. All columns stay.
    """
    row, id_ = fresh("__row", docs), fresh("__gone", docs)
    docs = told_apart(docs, "doc_id", "text", row)
    found = near_duplicates(docs, size=5, percent=80, id_col=row)
    gone = stored(found.filter(~F.col("kept")).select(F.col("doc_id").alias(id_)).distinct(), "near_duplicates")
    return docs.join(gone, docs[row] == gone[id_], "left_anti").drop(row)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; a null text stays null, all other columns stay."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens: where each lies, and its ids. A null text is its end id."""
    out = pack(docs, vocabulary("byte_bpe_50k.json"), Limits(tokens=1024, segments=256, loss_tokens=1024), cut=True, end_id=0)
    return out.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", privacy), ("packing", packing)]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
