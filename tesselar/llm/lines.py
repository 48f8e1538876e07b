"""Line dedup over levelled sorted runs of line hashes.

A store keeps runs of ``(h1, h2, docs)``: 128-bit line keys with the number of documents each was seen in, bucketed and
sorted by the key, so that runs meet by merge joins without a new shuffle. A batch of documents is aggregated to its own
run; keys that are settled already (seen in enough documents) are anti-joined away, the rest is added at level 0. When a
level holds ``fanout`` runs they are compacted into one run of the next level, and keys that have reached the threshold
by then move to the settled runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, dropped, fresh, let, shared_dir, stored

#: Batches that the documents are dealt into, and runs of a level that are compacted into one of the next. With these the
#: third batch is the first to meet settled runs, and the fourth makes a second level.
BATCHES, FANOUT = 6, 2
#: Share of all lines from which a frequent line is looked up by broadcast: at most 1/HEAVY lines are.
HEAVY = 1 / 5000
#: Lines of one span of a document, whose dropped positions are held and looked up together.
SPAN = 512


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_key(text: Column) -> Column:
    """The keys of all lines that are not blank, in order: texts with equal keys lose the same lines."""
    return F.array_join(F.filter(F.transform(_split(text), line_key), lambda k: k != ""), "\n")


class LineRuns:
    """Levelled runs in the session's warehouse or shared folder; every run is a bucketed, sorted table."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3, buckets: int | None = None, name: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.tables: set[str] = set()
        self.settled: list[str] = []
        self.made = self.anti_joins = self.compactions = 0

    def _write(self, run: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        (
            run.select("h1", "h2", "docs").repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", f"{shared_dir(self.spark)}/tesselar/{table}").format("parquet").saveAsTable(table)
        )
        self.tables.add(table)
        return table

    def _merged(self, tables: list[str]) -> DataFrame:
        """Counts of several runs added up, by merge joins: a union of bucketed tables loses their partitioning."""
        out = self.spark.table(tables[0])
        for t in tables[1:]:
            new = self.spark.table(t).withColumnRenamed("docs", "more").hint("merge")
            out = out.join(new, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return out

    def add(self, batch: DataFrame) -> None:
        """``batch``: rows ``(doc_id, h1, h2)``; a document belongs to one batch only."""
        run = batch.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"))
        for t in self.settled:
            self.anti_joins += 1
            run = run.join(self.spark.table(t).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(run))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int, upto: bool = False) -> None:
        """Merge the runs of a level (``upto``: and of all below) into one of the next; move what has settled."""
        parts = [t for x in (self.levels[: level + 1] if upto else self.levels[level : level + 1]) for t in x]
        if len(self.levels) < level + 2:
            self.levels.append([])
        if parts:
            self.compactions += 1
            run = self._merged(parts)  # merged twice, which costs less than a third table
            self.settled.append(self._write(run.filter(F.col("docs") >= self.min_docs)))
            self.levels[level + 1].append(self._write(run.filter(F.col("docs") < self.min_docs)))
            self.drop(parts)
        for x in range(0 if upto else level, level + 1):
            self.levels[x] = []

    def frequent(self) -> DataFrame:
        """All keys seen in at least ``min_docs`` documents, after a full compaction, with the documents counted until they
        settled (``docs``)."""
        if any(self.levels):
            self.compact(len(self.levels) - 1, upto=True)
        if not self.settled:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long")
        return self._merged(self.settled).select("h1", "h2", "docs")

    def close(self) -> None:
        """Drop all runs: a store that lasts is one that is not closed."""
        self.drop(list(self.tables))

    def drop(self, tables: list[str]) -> None:
        sc = self.spark.sparkContext
        self.tables -= set(tables)
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/tesselar/{t}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _hashes(docs: DataFrame, text_col: str, id_col: str, min_chars: int, batches: int) -> DataFrame:
    """``(doc_id, own, pos, h1, h2, batch)`` of every line whose key has ``min_chars`` code points or more; ``own`` tells the
    texts of an id apart."""
    at = F.posexplode(F.transform(_split(F.col(text_col)), line_key)).alias("pos", "_key")
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("own"), at).filter(F.char_length("_key") >= min_chars)
    return lines.select("doc_id", "own", "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(7), "_key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))


def _found(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The lines with a frequent key; the most frequent keys, which hold many lines each, are met without a shuffle."""
    heavy = common.filter(F.col("docs") >= F.lit(max(1, int(HEAVY * lines.count())))).select("h1", "h2")  # at most 1/HEAVY rows
    rest = common.join(F.broadcast(heavy), ["h1", "h2"], "left_anti").select("h1", "h2")
    met = lines.join(F.broadcast(heavy), ["h1", "h2"], "left_semi")
    return met.unionByName(lines.join(F.broadcast(heavy), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"], "left_semi"))


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT, text_col: str = "text", id_col: str = "doc_id", counts: tuple[str, str] = ("n_lines", "n_dropped"), runs: LineRuns | None = None
) -> DataFrame:
    """``docs`` with ``text`` replaced by the lines that stay, and the columns ``counts`` added: lines, and lines dropped.

    A line goes, in every document, when its key (see ``line_key``) has at least ``min_chars`` code points and occurs in
    at least ``min_docs`` documents. Null or empty text is one empty line and comes back as ''. Rows that share an id
    count as one document, as do all without one, but each loses only its own lines. All other columns of ``docs`` stay, whatever their
    names; columns named as ``counts`` are replaced. An empty table gives an empty result. ``runs`` is a store to use in
    place of a new one; it is closed.
    """
    spark = docs.sparkSession
    lines = stored(_hashes(docs, text_col, id_col, min_chars, batches), "lines")
    runs = runs or LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    common = stored(runs.frequent(), "frequent_lines")
    runs.close()
    doc, own, span, at, both = (fresh(x, docs) for x in ("__doc", "__own", "__span", "__at", "__both"))
    gone = _found(lines, common).select(F.col("doc_id").alias(doc), F.col("own").alias(own), "pos").distinct()
    # Positions are gathered by span first, so that a very long document is searched in short lists.
    spans = gone.groupBy(doc, own, F.expr(f"pos div {SPAN}").cast("int").alias(span)).agg(F.collect_list("pos").alias(at))
    held = fresh("__gone", docs)
    spans = stored(spans.groupBy(doc, own).agg(F.collect_list(F.struct(span, at)).alias(held)), "dropped_lines")
    dropped(spark, lines, common)
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans[doc]) & (F.xxhash64(docs[text_col]) == spans[own]), "left")

    none = F.array().cast("array<int>")

    def kept(parts: Column) -> Column:
        last = F.floor((F.size(parts) - 1) / SPAN).cast("int")
        by_span = F.transform(F.sequence(F.lit(0), last), lambda s: F.coalesce(F.get(F.filter(F.col(held), lambda g: g[span] == s), F.lit(0))[at], none))
        return let(by_span, lambda d: F.filter(parts, lambda _, i: ~F.array_contains(F.get(d, F.floor(i / SPAN).cast("int")), i)))

    split = let(_split(F.col(text_col)), lambda p: F.struct(F.size(p).cast("long").alias("n"), F.when(F.col(held).isNull(), p).otherwise(kept(p)).alias("left")))
    names = [c for c in docs.columns if c not in counts or c == text_col]
    out = joined.select(*[docs[c] for c in names if c != text_col], split.alias(both))
    text = F.array_join(f"{both}.left", "\n").alias(text_col)
    return out.select(*[text if c == text_col else F.col(c) for c in names], F.col(f"{both}.n").alias(counts[0]), (F.col(f"{both}.n") - F.size(f"{both}.left")).cast("long").alias(counts[1]))
