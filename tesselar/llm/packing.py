"""Vector bin packing of examples into sequences.

Each task packs the rows it reads: a pool of waiting examples, one open sequence, and the dot product of what an example
takes with what the sequence has left, over three limits at once (tokens, segments, loss-bearing tokens). No shuffle, no
state outside the pool; a task that runs again packs the same rows the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tables
from .common import for_python

#: Examples that wait in a task's pool; each holds less than a sequence of ids.
POOL = 1024
#: Sequence ids of a task begin at its partition times this.
IDS_A_TASK = 1 << 36


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


@dataclass
class Piece:
    """Tokens ``start`` to ``start + n`` of an example; those from ``prompt`` on bear loss."""

    key: object
    ids: bytes
    start: int
    total: int
    prompt: int

    @property
    def n(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, self.start + self.n - max(self.start, self.prompt))

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of the first tokens stay within both limits."""
        return min(self.n, tokens, max(0, self.prompt - self.start) + loss)

    def cut(self, k: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.ids[: 4 * k], self.start, self.total, self.prompt), Piece(self.key, self.ids[4 * k :], self.start + k, self.total, self.prompt)


class Packer:
    def __init__(self, limits: Limits, cut: bool, pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.cut, self.size = limits, cut, pool
        self.waiting: list[Piece] = []
        self.takes = np.zeros((0, 3))  # tokens, segments and loss of those that wait

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take an example; give the sequences that are complete by it."""
        while (k := piece.fitting(self.limits.tokens, self.limits.loss_tokens)) < piece.n:  # longer than a sequence: cut in any case
            head, piece = piece.cut(k)
            if k == self.limits.tokens:
                yield [head]
            else:
                self.waiting.append(head)
        self.waiting.append(piece)
        if len(self.waiting) >= 2 * self.size:
            yield from self.fill(self.size)

    def fill(self, keep: int = 0) -> Iterator[list[Piece]]:
        """Fill sequences until ``keep`` examples or fewer wait."""
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        takes = np.array([(p.n, 1, p.loss) for p in self.waiting], float).reshape(-1, 3)
        open_ = np.ones(len(takes), bool)
        left_over = len(takes)
        while left_over > keep:
            left, chosen = most.copy(), []
            while left_over:
                fits = open_ & (takes <= left).all(axis=1)
                if not fits.any():
                    break
                score = np.where(fits, takes @ (left / most**2), -1)
                i = int(score.argmax())
                chosen.append(self.waiting[i])
                left -= takes[i]
                open_[i], left_over = False, left_over - 1
            if self.cut and left_over and left[0] >= 1 and left[1] >= 1:
                i = int(np.where(open_, takes[:, 0], -1).argmax())
                if k := self.waiting[i].fitting(int(left[0]), int(left[2])):
                    head, self.waiting[i] = self.waiting[i].cut(k)
                    chosen.append(head)
                    takes[i] = self.waiting[i].n, 1, self.waiting[i].loss
            yield chosen
        self.waiting = [p for p, o in zip(self.waiting, open_, strict=True) if o]


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), cut: bool = True, end_id: int | None = 0, prompt_col: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokenize examples and pack them: one row per piece, with ``doc_id, start, length, doc_tokens, sequence_id, offset,
    loss_tokens, ids`` (little-endian unsigned 32-bit ids of the piece).

    prompt_col: code points of the text that bear no loss, as in instruction data (null or no column: all bear loss); the
    prompt's tokens are those of the prompt alone. cut: examples may be cut to fill a sequence; else only examples longer
    than a sequence are. end_id closes every example. Null text counts as empty: the end id alone (nothing, if there is no
    end id). Repeated rows are packed as often as they come; ties go to the example that came first. An empty table gives
    an empty result. Other columns are not read. ``sequence_id`` is unique; it and what shares a sequence depend on how
    ``docs`` is split into tasks, so read ``docs`` from a table where the result must be the same each time.
    """
    for_python(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *([docs[prompt_col].cast("long").alias("prompt")] if prompt_col else []))
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens")
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        table, packer = tables.byte_bpe(tokenizer), Packer(limits, cut)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        rows: list[tuple] = []
        next_id = TaskContext.get().partitionId() * IDS_A_TASK

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            rows.clear()
            return out

        def put(sequence: list[Piece]) -> None:
            nonlocal next_id
            at = 0
            for p in sequence:
                rows.append((p.key, p.start, p.n, p.total, next_id, at, p.loss, p.ids))
                at += p.n
            next_id += 1

        for b in batches:
            prompts = b.column("prompt").to_pylist() if prompt_col else [None] * b.num_rows
            for key, text, prompt in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), prompts, strict=True):
                text = text or ""
                ids = table.ids(text) + end
                silent = len(table.ids(text[: max(0, prompt)])) // 4 if prompt else 0
                if ids:
                    for sequence in packer.add(Piece(key, ids, 0, len(ids) // 4, silent)):
                        put(sequence)
                if len(rows) >= 2000:
                    yield batch()
        for sequence in packer.fill():
            put(sequence)
        if rows:
            yield batch()

    return source.mapInArrow(run, schema)
