"""Exact top-k inner products by block-at-a-time pruning.

Rows lie in blocks of consecutive ids, blocks in super-blocks; a block's forward index is the integer matrix of its rows,
its summary the largest and smallest value of every term (dimension). For a query, a block's bound is the sum over terms of
the most that the summary allows; blocks are scored in order of their bounds until no bound reaches the k-th score found.

First only the summaries of super-blocks, one row for thousands, meet the queries: each query is scored in the super-block
of its largest bound, and its k-th score there prunes the other super-blocks. Rows and queries meet in the cells that are
left, of one group of queries and one super-block each, both of bounded size, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, stored

#: Rows of a block, of a super-block that one task holds, and queries of a group; summaries that meet a group at once.
BLOCK, SUPER, GROUP, SUMMARIES = 64, 8192, 4096, 512


def usable(vec: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad)


def quantized(vec: Column, scale: int = 256) -> Column:
    """Every component x as floor(scale * x) in double arithmetic."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _best(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: object, k: int, least: float, order: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """(score, id) of the k best rows for a query, of those with a score of ``least`` or more; ``rows`` are sorted by id in
    blocks beginning at ``starts``."""
    scores, found = np.zeros(0), np.zeros(0, np.int64)
    for b in order:
        if bounds[b] < least:  # equal bounds may still hold a smaller id
            break
        part = slice(starts[b], starts[b + 1])
        s, at = rows[part] @ q, np.arange(starts[b], starts[b + 1])
        keep = (s >= least) & (ids[part] != own)
        scores, found = np.concatenate([scores, s[keep]]), np.concatenate([found, at[keep]])
        if len(scores) > k:
            best = np.lexsort((ids[found], -scores))[:k]
            scores, found = scores[best], found[best]
        if len(scores) == k:
            least = max(least, scores.min())
    best = np.lexsort((ids[found], -scores))[:k]
    return [(int(scores[i]), int(ids[found[i]])) for i in best]


def _cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple[int, int, int]] = []
    if len(queries) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable")
        width = max(map(len, [*queries["vec"], *rows["vec"]]), default=0)
        data, ids = _matrix(rows["vec"], width), rows["vec_id"].to_numpy()
        asked = _matrix(queries["vec"], width)
        if width * max(np.abs(data).max(initial=0), 1) * max(np.abs(asked).max(initial=0), 1) >= 2**53:  # doubles would round
            data, asked = data.astype(np.int64).astype(object), asked.astype(np.int64).astype(object)
        starts = np.array([*range(0, len(data), BLOCK), len(data)])
        tops = np.array([data[a:b].max(axis=0) for a, b in zip(starts, starts[1:], strict=False)])
        lows = np.array([data[a:b].min(axis=0) for a, b in zip(starts, starts[1:], strict=False)])
        bounds = np.maximum(asked, 0) @ tops.T + np.minimum(asked, 0) @ lows.T
        for q, own, limit, least in zip(asked, queries["query_id"], bounds, queries["least"].astype(float).fillna(-np.inf), strict=True):
            out += [(own, i, s) for s, i in _best(q, data, ids, own, k, least, np.argsort(-limit, kind="stable"), limit, starts)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _bounded(choose: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """(query_id, _s, bound) of the queries of a group and the super-blocks of a chunk that ``choose`` picks from the bounds."""

    def run(queries: pd.DataFrame, supers: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(supers):
            return pd.DataFrame({"query_id": [], "_s": [], "bound": []}).astype({"query_id": "int64", "_s": "int64", "bound": "float64"})
        width = max(map(len, [*queries["vec"], *supers["top"]]), default=0)
        asked, tops, lows = _matrix(queries["vec"], width), _matrix(supers["top"], width), _matrix(supers["low"], width)
        bounds = np.maximum(asked, 0) @ tops.T + np.minimum(asked, 0) @ lows.T
        bounds *= 1 + np.sign(bounds) * 1e-12  # sums of doubles may fall short by rounding
        at, block = choose(bounds, queries["least"].to_numpy(float))
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[at], "_s": supers["_s"].to_numpy()[block], "bound": bounds[at, block]})

    return run


def _summaries(held: DataFrame) -> DataFrame:
    """(_s, top, low, _c): the largest and smallest value of every term in a super-block; shorter vectors have zeros behind."""
    rows = held.groupBy("_s").agg(F.count("*").alias("rows"))
    terms = held.select("_s", F.posexplode("vec").alias("i", "v")).groupBy("_s", "i").agg(F.max("v").alias("top"), F.min("v").alias("low"), F.count("*").alias("n")).join(rows, "_s")
    some = F.col("n") < F.col("rows")
    edge = F.struct("i", F.when(some, F.greatest("top", F.lit(0))).otherwise(F.col("top")).alias("top"), F.when(some, F.least("low", F.lit(0))).otherwise(F.col("low")).alias("low"))
    each = terms.groupBy("_s").agg(F.array_sort(F.collect_list(edge)).alias("e"))
    return each.select("_s", F.col("e.top").alias("top"), F.col("e.low").alias("low"), F.floor(F.col("_s") / SUMMARIES).cast("int").alias("_c"))


def _met(asked: DataFrame, summaries: DataFrame, groups: int, chunks: int, choose: Callable) -> DataFrame:
    """Queries and super-blocks chosen by their bounds. Only summaries are copied for groups (one of GROUP queries), and queries
    for chunks (one of SUMMARIES * SUPER rows)."""
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left, right = each(asked, "_c", chunks).groupBy("_g", "_c"), each(summaries, "_g", groups).groupBy("_g", "_c")
    return left.cogroup(right).applyInPandas(_bounded(choose), "query_id long, _s long, bound double")


def _scored(asked: DataFrame, held: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query in every super-block it is paired with."""
    dealt = stored(asked.join(pairs.select("query_id", "_s"), "query_id"), "pairs")
    cells = stored(dealt.select("_s", "_g").distinct(), "cells")
    left, right = dealt.groupBy("_s", "_g"), held.join(cells, "_s").groupBy("_s", "_g")
    return stored(left.cogroup(right).applyInPandas(lambda q, r: _cell(q, r, k), "query_id long, vec_id long, score long"), "scores")


def surviving(queries: DataFrame, rows: DataFrame, k: int = 5, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = 256, super_rows: int = SUPER) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries with the least score that still counts, rows, the scores in each query's first super-block, and the other pairs
    of query and super-block that no bound rules out."""
    short = lambda df, name: df.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias(name), quantized(F.col(vec_col), scale).alias("vec"))
    asked, held = short(queries, "query_id").dropDuplicates(["query_id"]), short(rows, "vec_id")
    # Consecutive ids share a super-block where ids are dense; any dealing is right, for bounds are taken from the rows.
    span = held.agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"), F.count("*").alias("n")).first()
    supers, groups = -(-span["n"] // super_rows) or 1, -(-queries.count() // GROUP) or 1
    lo, wide = span["lo"] or 0, max(1, -(-((span["hi"] or 0) - (span["lo"] or 0) + 1) // supers))
    # Repeated ids could fill a super-block without end: their copies are dealt over all.
    copies = held.groupBy("vec_id").agg(F.count("*").alias("n")).filter(F.col("n") > super_rows).select("vec_id")
    own = F.floor((F.col("vec_id") - lo) / wide)
    hot = held.join(copies, "vec_id", "left_semi").withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(supers)))
    held = stored(held.join(copies, "vec_id", "left_anti").withColumn("_s", own.cast("long")).unionByName(hot), "rows")
    asked = stored(asked.withColumn("_g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("least", F.lit(None).cast("double")), "queries")
    summaries = stored(_summaries(held), "summaries")
    chunks = -(-supers // SUMMARIES)
    top = _met(asked, summaries, groups, chunks, lambda bounds, _: (np.arange(len(bounds)), bounds.argmax(axis=1)))
    first = stored(top.groupBy("query_id").agg(F.max(F.struct("bound", "_s"))["_s"].alias("_s")), "first")
    seeds = _scored(asked, held, first, k)
    kth = seeds.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))  # k at most each
    asked = stored(asked.drop("least").join(kth, "query_id", "left"), "seeded")
    left = _met(asked, summaries, groups, chunks, lambda bounds, least: np.nonzero(~(bounds < least[:, None])))
    return asked, held, seeds, stored(left.join(first, ["query_id", "_s"], "left_anti"), "surviving")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = 256, super_rows: int = SUPER) -> DataFrame:
    """For each query its k rows of largest integer inner product: ``query_id, rank, vec_id, score``.

    Components are quantized (see ``quantized``). A row is no candidate of the query with its own id. Ties go to the
    smaller id; fewer candidates than k are all returned. Vectors that are null or hold null or non-finite components,
    and rows without id, take no part. Shorter vectors count as if filled with zeros. A query that repeats is answered
    once, a row that repeats takes a rank for each copy. Empty tables give an empty result. Other columns are not read.
    """
    for_python(rows.sparkSession)
    asked, held, seeds, pairs = surviving(queries, rows, k, vec_col, id_col, scale, super_rows)
    found = seeds.unionByName(_scored(asked, held, pairs, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # pruned by each task before the shuffle
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
