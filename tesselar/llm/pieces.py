"""SentencePiece encoding and decoding with a table of distinct marked words.

A task takes the texts of its partition by windows of bounded size and goes over each window twice: first it gathers the
distinct marked words and segments each once, then it joins their ids back by position. One table over the whole corpus
would have to meet every text by a shuffle of all words or of all texts, or grow with the corpus in every worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tables
from .common import for_python

#: Bytes of text that share a table of distinct words (one batch at least); a table takes a few times as much at most.
WINDOW = 16 << 20


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id column, ``ids`` (array of int) and ``decoded`` (what the ids decode to).

    Encoding equals the library's, without begin and end ids and without sampling. Null text counts as empty: no ids,
    decoded ''. Rows are handled one by one, so repeated rows come out repeated; an empty table gives an empty result.
    Other columns of ``docs`` are not read. ``model`` is a path that every executor can read.
    """
    for_python(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        pieces, arrow = tables.pieces(model), to_arrow_schema(schema)
        window: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            texts = lambda b: (x or "" for x in b.column("text").to_pylist())
            table = pieces.table(x for b in window for x in texts(b))
            for b in window:
                found = [tables.joined(x, table) for x in texts(b)]
                ends = pa.array([0, *accumulate(len(ids) // 4 for ids, _ in found)], pa.int32())
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join([x[0] for x in found]), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids.cast(arrow.field("ids").type), pa.array([x[1] for x in found], pa.string())], schema=arrow)
            window.clear()

        for b in batches:
            if b.num_rows:
                window.append(b)
            if sum(x.nbytes for x in window) > WINDOW:
                yield from out()
        if window:
            yield from out()

    return source.mapInArrow(run, schema)
