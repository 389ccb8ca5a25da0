"""Helpers that the text operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS = 1024  # rows that Python code handles at a time
BITS = 1 << 25  # of a bitmap of hashed ids, 4 MB

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a bounded row count."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a bounded row count and about ``size`` bytes of their second column, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, done + size, side="right"))
            to = max(at + 1, min(to, at + rows, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to


@contextmanager
def no_collections() -> Iterator[None]:
    """For code that makes many objects and no cycles, where searches for cycles only cost time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def folded(column: Column, parts: int) -> Column:
    """A salt from 0 to ``parts - 1`` that depends on the given value only."""
    return F.pmod(F.xxhash64(column), F.lit(parts))


def maybe_among(rows: DataFrame, hashed: Column, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` and a column that is false only if the hash of the row is not among the column ``hash`` of ``ids``.

    A bitmap of ``BITS`` bits at most, and so of a known size, goes to every task.
    """
    bucket, bits = f"{name}_bucket", f"{name}_bits"
    bit = lambda x: F.pmod(x, F.lit(BITS)) + 1
    place = F.bitmap_bit_position(bit(hashed))
    maps = ids.groupBy(F.bitmap_bucket_number(bit(F.col("hash"))).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(F.col("hash")))).alias(bits))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(bit(hashed))).join(F.broadcast(maps), bucket, "left")
    return marked.withColumn(name, F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))).drop(bucket, bits)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
