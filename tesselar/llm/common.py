"""What the operators of this subpackage share: the shared work folder, row-wise helpers, word rules."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the text contracts: space and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes handed to a Python worker at once: whole texts are long, other rows short.
ARROW_ROWS, ARROW_BYTES = 20_000, 1_500_000
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Used only where a local session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_SHARED


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesselar/{what}-{uuid.uuid4().hex}"
    was = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")  # the table replaces what was shuffled to make it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def for_python(spark: SparkSession) -> None:
    """Bound what one Arrow batch takes, and let Python workers find this package as the driver does.

    The bounds stay, as results are computed after their operator has returned; they are the same for all operators.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in [*known.split(os.pathsep), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()  # bytes.lower() and bytes.split() know ASCII only


def told_apart(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with a whole number ``name`` for each id and text, in order of the ids; null where the id is.

    It is the id where no two rows share one. Otherwise ids and hashes of texts are sorted by ranges and numbered in that
    order, and the numbers are joined back: rows of one id and one text share a number, no others do.
    """
    id_ = F.col(id_col).cast("long")
    if docs.groupBy(id_.alias("id")).count().filter("id is not null and count > 1").isEmpty():
        return docs.withColumn(name, id_)
    key, text = fresh("__key", docs), fresh("__hash", docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.filter(id_.isNotNull()).select(id_.alias(key), F.xxhash64(text_col).alias(text)).distinct()
    numbers = stored(keys.repartitionByRange(parts, key, text).sortWithinPartitions(key, text).withColumn(name, F.monotonically_increasing_id()), "row_numbers")
    rows = docs.withColumns({key + "_": id_, text + "_": F.xxhash64(text_col)})
    met = rows.join(numbers, (rows[key + "_"] == numbers[key]) & (rows[text + "_"] == numbers[text]), "left")
    return met.select(*[docs[c] for c in docs.columns], numbers[name])


def met_by_weight(rows: DataFrame, keyed: DataFrame, on: str, weight: str, total: int, heavy: int = 2000, how: str = "left") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and in ``weight`` how many of the ``total`` rows have it.

    Keys with a share of 1/heavy of the rows or more, ``heavy`` of them at most, are broadcast; so a key that holds a third
    of all rows is joined where its rows lie, and no other key is large.
    """
    limit = max(1, -(-total // heavy))
    few = F.broadcast(keyed.filter(F.col(weight) >= limit).drop(weight))
    many = keyed.filter(F.col(weight) < limit).drop(weight)
    large = rows.join(few, on)
    return large.unionByName(rows.join(few.select(on), on, "left_anti").join(many, on, how))
