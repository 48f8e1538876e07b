"""The prefix trie of conversations, with sums over subtrees rolled up by pointer jumping.

A node is a sequence of turns that conversations begin with. Its digest is the exclusive or of the hashes of its turns,
each hashed with its place, so the digests of all prefixes of a conversation come from one running aggregate, and a node's
parent from its own digest and its last turn. Nodes and parent edges are one aggregation by digest.

Sums over subtrees take as many rounds as the greatest depth has binary digits: in round k every node that lies 2^k deep
or deeper hands what it has gathered to its ancestor 2^k above, and then looks up that ancestor's ancestor. After round k
a node has gathered all that lies less than 2^(k+1) below it. Nodes that are not deep enough have no further ancestor and
drop out, so a round works on fewer rows than the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, for_python, met_by_weight, stored

#: Bytes of joined ids that are handed on at once to be hashed.
PIECE = 1 << 16
NODE = ["depth", "k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, t1, t2, bytes) of every turn in the order of its conversation, which has ids only: rows without one are
    left out. Rows that share a turn are put in the order of role and text, by a digest."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(7), role, text).alias("t2"), F.octet_length(text).cast("long").alias("bytes")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")) - 1
    return rows.select("conv_id", place.alias("i"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame, convs: DataFrame, total: int) -> DataFrame:
    """(conv_id, pos, t1, t2, bytes): the first h turns of conversation c - c%5, then c's own after its first h; ``convs`` has
    (conv_id, n, h, p), with p the turns that are taken over."""
    taken = turns.filter("i < 8").select(F.col("conv_id").alias("base"), F.col("i").alias("pos"), "t1", "t2", "bytes")
    begun = convs.select("conv_id", "p", (F.col("conv_id") - F.col("conv_id") % 5).alias("base")).join(taken, "base").filter("pos < p")
    own = met_by_weight(turns, convs.select("conv_id", "h", "p", "n"), "conv_id", "n", total, how="inner").filter("i >= h")
    return begun.select("conv_id", "pos", "t1", "t2", "bytes").unionByName(own.select("conv_id", (F.col("p") + F.col("i") - F.col("h")).alias("pos"), "t1", "t2", "bytes"))


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (depth, k1, k2, conv_id) in order: of each node the ids joined by commas, in pieces of bounded size."""
    node, ids, size, made = None, [], 0, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True))
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j == 4 else pa.int64()) for j, c in enumerate(columns)], names=[*NODE, "first", "ids"])

    for b in batches:
        for *key, c in zip(*(b.column(x).to_pylist() for x in (*NODE, "conv_id")), strict=True):
            if ids and (key != node or size > PIECE):
                made.append((*node, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
                if len(made) >= 1_000:
                    yield out()
            node = key
            ids.append(c)
            size += 12
    if ids:
        made.append((*node, ids[0], ",".join(map(str, ids))))
    if made:
        yield out()


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in order: the hash of each node's joined ids."""
    node, digest, made = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True))
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j == 3 else pa.int64()) for j, c in enumerate(columns)], names=[*NODE, "ends_sha256"])

    for b in batches:
        for *key, ids in zip(*(b.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
            if key == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                made.append((*node, digest.hexdigest()))
                if len(made) >= 5_000:
                    yield out()
            node, digest = key, hashlib.sha256(ids.encode())
    if node is not None:
        made.append((*node, digest.hexdigest()))
    if made:
        yield out()


def ends(reached: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes that conversations end at. ``reached``: (depth, k1, k2, conv_id). Ids are dealt by
    ranges, so those of a node where a third of all conversations end are joined in many tasks; one task hashes the pieces."""
    parts = int(reached.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = reached.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(_ends, "depth long, k1 long, k2 long, ends_sha256 string")


def _key(*names: str) -> Column:
    return F.struct(*[F.col(n).alias(k) for n, k in zip(names, NODE, strict=True)])


def rolled_up(nodes: DataFrame, depth: int) -> DataFrame:
    """(key, leaves, saved): what lies below each node that has something below, in rounds of doubled distance.

    ``nodes``: (key, above, depth, leaf, saved), ``above`` the parent's key. Sums go up by partial aggregation, and pointers
    of ancestors that many nodes share are broadcast, at most 2,000.
    """
    spark = nodes.sparkSession
    active = stored(nodes.filter("depth >= 1").select("key", F.col("above").alias("up"), "depth", F.col("leaf").alias("leaves"), "saved"), "trie_round")
    gathered, far = [], 1
    while far <= depth:
        got = stored(active.groupBy("up").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")).withColumnRenamed("up", "key"), "trie_sums")
        gathered.append(got.select("key", "leaves", "saved"))
        far *= 2
        if far <= depth:
            ahead = active.filter(F.col("depth") >= far)
            more = got.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
            now = ahead.join(more, "key", "left").select("key", F.col("up").alias("via"), "depth", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
            # The ancestor's own pointer: it lies at least far / 2 deep, so it has one and it is still active.
            pointers = active.select("key", F.col("up")).join(got.select("key", "n"), "key").withColumnRenamed("key", "via")
            new = stored(met_by_weight(now, pointers, "via", "n", max(1, ahead.count()), how="inner").select("key", "up", "depth", "leaves", "saved"), "trie_round")
            dropped(spark, active)
            active = new
    dropped(spark, active)
    if not gathered:
        return nodes.limit(0).select("key", F.col("leaf").alias("leaves"), "saved")
    return reduce(DataFrame.unionByName, gathered).groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the conversations, which are first rebuilt to share beginnings
    (see ``rebuilt``): ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conv_id`` is the smallest member, ``saved_tokens`` what sharing saves in the node's subtree in bytes of texts,
    ``ends_sha256`` hashes the ids of those that end there. Null roles and texts are empty; null turns come first, rows that
    share a turn in the order of their hashes, and rows that come twice are two turns. Rows without conv_id belong to no
    conversation and are left out. An empty table gives an empty result; other columns are not read. Prefixes are told
    apart by 128 bits.
    """
    spark = conversations.sparkSession
    for_python(spark)
    turns = stored(numbered(conversations), "turns")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    sized = stored(own.select("conv_id", "n", h.alias("h")), "conversations")
    bases = sized.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(sized.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(bases, "base", "left").select("conv_id", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("p")), "rebuilt_sizes")
    whole = sized.agg(F.sum("n").alias("turns"), F.count("*").alias("convs"), F.min("conv_id").alias("least")).first()
    rows = rebuilt(turns, convs, whole["turns"] or 1)

    run = Window.partitionBy("conv_id").orderBy("pos")
    hashed = rows.select("conv_id", "pos", "bytes", F.xxhash64("pos", "t1", "t2").alias("h1"), F.xxhash64(F.lit(7), "pos", "t2", "t1").alias("h2"))
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    met = hashed.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "bytes", "h1", "h2", F.bit_xor("h1").over(so_far).alias("k1"), F.bit_xor("h2").over(so_far).alias("k2"), F.lead("pos").over(run).isNull().alias("last"))
    met = stored(met, "prefixes")
    dropped(spark, turns, sized)
    deepest = met.agg(F.max("depth")).first()[0] or 0

    node = met.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("k1").bitwiseXOR(F.col("h1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("k2")]
    below = stored(node.select(_key(*NODE).alias("key"), F.struct(*up).alias("above"), "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie_nodes")
    root_key = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    none = F.lit(None).cast("struct<depth:bigint,k1:bigint,k2:bigint>")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(root_key.alias("key"), none.alias("above"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("saved"))
    tree = below.unionByName(root)

    children = stored(below.groupBy("above").agg(F.count("*").alias("n_children")).withColumnRenamed("above", "key"), "trie_children")
    nodes = stored(tree.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    sums = rolled_up(nodes.select("key", "above", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved"), deepest).withColumnRenamed("saved", "saved_below")
    # A parent that many nodes share is broadcast with its id.
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    with_parent = met_by_weight(nodes.filter("depth > 0").drop("n_children"), parents, "above", "n_children", max(1, below.count()), how="inner").select("key", "parent_conv_id")

    turnless = convs.join(met.filter("last").select("conv_id"), "conv_id", "left_anti").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id")
    ended = ends(met.filter("last").select(*NODE, "conv_id").unionByName(turnless)).select(_key(*NODE).alias("key"), "ends_sha256")
    out = nodes.join(sums, "key", "left").join(with_parent, "key", "left").join(ended, "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", ((F.col("n_children") == 0).cast("long") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
