"""Best-fit packing of token pieces into sequences.

Each task keeps a fixed number of open sequences, found through a bitset keyed
by free space: the lowest set bit at or above a piece's length is the best fit.
A new sequence beyond that number closes the fullest open one first.

Nulls: a null text is an empty one, of the end id alone. Repeated rows are packed
as often as they occur. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cairn.llm.common import no_collections, text_slices
from cairn.llm.tokens import encoder, public_file
from cairn.session import Stages

LENGTH = 2048
OPEN_BINS = 4096
END_ID = 0


class OpenBins:
    """At most ``limit`` open sequences of ``size`` tokens."""

    def __init__(self, size: int = LENGTH, limit: int = OPEN_BINS):
        self.size, self.limit, self.count, self.made, self.bits = size, limit, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The sequence for a piece, and the piece's offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_, self.size - free


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document, cut only where longer than ``size``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(public_file(tokenizer))
        for batch in text_slices(batches):
            rows = []
            with no_collections():
                ids, sizes = tool.encode(batch.column(1), END_ID)
            for key, own in zip(batch.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1])):
                data = own.tobytes()
                for k in range(-(-len(data) // (4 * size))):
                    part = data[4 * size * k : 4 * size * (k + 1)]
                    row = (key, k, size * k, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<i4"),) if with_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[: len(rows[0])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(parts: DataFrame, total: int, size: int = LENGTH, limit: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``size``.

    ``total`` is the sum of all lengths: it sets how many tasks pack, each with
    about as many sequences as may be open. Large pieces come first in a task,
    so that the small ones fill what they leave.
    """
    tasks = max(1, -(-total // (limit * size)))
    schema = parts.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",sequence_id:bigint,offset:bigint"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(size, limit), TaskContext.get().partitionId() << 40
        for frame in frames:
            placed = [bins.place(n) for n in frame["length"].tolist()]
            yield frame.assign(sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed])

    return (
        parts.repartition(tasks, "doc_id", "piece")
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece")
        .mapInPandas(place, schema)
    )


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = LENGTH, limit: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces and pack them; tokens are made once and kept as a table."""
    kept = Stages(docs.sparkSession).cut(pieces(docs, tokenizer, size, with_ids))
    total = kept.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return pack(kept, total, size, limit)
