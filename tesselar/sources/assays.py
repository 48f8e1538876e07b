"""Readers of instrument exports in table form: matrices as (barcode, feature, value) rows, positions beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a headerless positions file (fixed values).
POSITIONS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres")
_READERS: dict[str, Callable] = {}


def reader(assay: str):
    def add(f):
        _READERS[assay] = f
        return f

    return add


def read(spark: SparkSession, assay: str, path: str, **options) -> dict[str, DataFrame]:
    """``obs`` and ``expr`` of an export; the reader is found by the assay's name."""
    key = assay.lower().replace("-", "").replace("_", "")
    if key not in _READERS:
        raise KeyError(f"no reader for {assay!r}; known: {sorted(_READERS)}")
    return _READERS[key](spark, path, **options)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def tissue_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet, else CSV with a header, else CSV without."""
    if _exists(spark, f"{folder}/tissue_positions.parquet"):
        return spark.read.parquet(f"{folder}/tissue_positions.parquet")
    if _exists(spark, f"{folder}/tissue_positions.csv"):
        return spark.read.csv(f"{folder}/tissue_positions.csv", header=True, inferSchema=True)
    schema = ", ".join(f"{c} {'string' if c == 'barcode' else 'int'}" for c in POSITIONS)
    return spark.read.csv(f"{folder}/tissue_positions_list.csv", schema=schema)


@reader("visium")
def visium(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``matrix.parquet(barcode, feature, value)`` and ``spatial/`` positions; a barcode without a position is an error."""
    expr = spark.read.parquet(f"{path}/matrix.parquet").select(F.col("barcode").alias("obs_id"), F.col("feature").alias("gene_id"), F.col("value").cast("double").alias("value"))
    pos = tissue_positions(spark, f"{path}/spatial").select(F.col("barcode").alias("obs_id"), F.col("pxl_col_in_fullres").cast("double").alias("x"), F.col("pxl_row_in_fullres").cast("double").alias("y"), "in_tissue")
    obs = expr.select("obs_id").distinct().join(pos, "obs_id", "left")
    missing = obs.filter(F.col("x").isNull()).limit(1).collect()
    if missing:
        raise ValueError(f"no position for barcode {missing[0].obs_id}")
    return {"obs": obs, "expr": expr}


@reader("xenium")
def xenium(spark: SparkSession, path: str, gene_expression_only: bool = True) -> dict[str, DataFrame]:
    """``cells.parquet`` and ``matrix.parquet(cell_id, feature, feature_type, value)``; control probes are left out."""
    m = spark.read.parquet(f"{path}/matrix.parquet")
    if gene_expression_only:
        m = m.filter(F.col("feature_type") == "Gene Expression")
    cells = spark.read.parquet(f"{path}/cells.parquet")
    obs = cells.select(F.col("cell_id").alias("obs_id"), F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y"))
    return {"obs": obs, "expr": m.select(F.col("cell_id").alias("obs_id"), F.col("feature").alias("gene_id"), F.col("value").cast("double").alias("value"))}


def _exported(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Exports that are in this library's schema already: ``obs.parquet`` and ``expr.parquet``."""
    return {"obs": spark.read.parquet(f"{path}/obs.parquet"), "expr": spark.read.parquet(f"{path}/expr.parquet")}


for _assay in ("merfish", "merscope", "cosmx", "slideseq", "stereoseq"):
    reader(_assay)(_exported)
