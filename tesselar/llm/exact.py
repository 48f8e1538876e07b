"""Exact dedup by a heavy-hitter split.

Frequent digests are found by Misra-Gries counters (``freqItems`` keeps at most 1/support of them for each task and
merges those), counted exactly, and their winners broadcast: copies in large groups are resolved map-side. All other
digests take the ordinary shuffle, where no group can hold more than ``support`` of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, stored

#: Share of the rows from which a digest counts as heavy; at most 1/SUPPORT digests are collected and broadcast.
SUPPORT = 1 / 2000


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _best(id_col: str) -> Column:
    """Orders the rows of a group: most code points first, then the smallest id; null ids come last."""
    return F.struct(F.col("_n"), F.col(id_col).isNotNull().alias("_has"), (-F.col(id_col)).alias("_neg"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after white space is deleted; the longest original stays, then the smallest id.
    Null text counts as empty, so null, empty and blank texts form one group. A row that repeats (same id, same text)
    is a copy like any other: it counts in ``group_size``, and as ``kept`` is ``doc_id = keep_id`` all rows of that
    id are kept. A null id loses ties; where it wins, ``keep_id`` is null and ``kept`` true for the rows without id.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"), F.char_length(text).alias("_n"))
    rows = stored(rows, "digests")

    # At most 1/support digests, so the list and what is broadcast from it are bounded whatever the input's size.
    found = rows.stat.freqItems(["text_sha256"], support).first()
    frequent = [x for x in (found[0] if found else [])]
    group = [F.count("*").alias("group_size"), F.max(_best("doc_id")).alias("_best")]

    def with_winner(joined: DataFrame) -> DataFrame:
        keep = F.when(F.col("_best").isNull(), F.col("doc_id")).otherwise(-F.col("_best._neg"))
        return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id").eqNullSafe(keep), F.lit(False)).alias("kept"), "text_sha256")

    if not frequent:
        winners = rows.limit(0).groupBy("text_sha256").agg(*group)
        rest = rows
        heavy = None
    else:
        listed = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in frequent], "text_sha256 string"))
        # Exact counts verify the candidates; copies by the million are partially aggregated before this small shuffle.
        winners = stored(rows.join(listed, "text_sha256", "left_semi").groupBy("text_sha256").agg(*group), "winners")
        heavy = rows.join(F.broadcast(winners), "text_sha256")
        rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(*group).filter("group_size > 1")
    out = with_winner(rest.join(groups, "text_sha256", "left"))
    return out if heavy is None else with_winner(heavy).unionByName(out)
