"""Token ids in patched frame-of-reference files.

A file row is a segment: the ids of some whole documents in a row. Its ids are
cut into blocks of ``BLOCK``. Each block stores its minimum and the differences
to it, packed at the width that holds ``PERCENT`` of them; wider differences go
to an exception list. The head of a segment lists its documents and where each
block and each exception list starts.

Nulls: a null text has only the end id; null doc_ids come first. Rows with one
doc_id come in the order of their texts, and every row is written. An empty
table gives no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairn.llm.common import no_collections, slices, text_slices
from cairn.llm.tokens import encoder, public_file

BLOCK = 512
PERCENT = 95
SEGMENT_IDS = 1 << 19  # a segment ends behind the document that fills it
END_ID = 0
_HEAD = struct.Struct("<4sIQII")
_MAGIC = b"PFR1"

SEGMENTS = "shard int, segment int, first_doc long, n_docs long, n_ids long, before long, payload binary"
_SEGMENTS = pa.schema(
    [("shard", pa.int32()), ("segment", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()),
     ("n_ids", pa.int64()), ("before", pa.int64()), ("payload", pa.binary())]
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The index rows of all blocks, and their bodies with the exceptions behind them."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENT // 100)
    width = np.ceil(np.log2(np.partition(delta, at, axis=1)[:, at] + 1.0)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 8))])
    body = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        part = delta[of]
        planes = [np.packbits((part >> j) & 1, axis=1) for j in range(w)]
        body[starts[of][:, None] + np.arange(w * (BLOCK // 8))] = np.concatenate(planes, axis=1)
    row, pos = np.nonzero(delta >> np.minimum(width, 31)[:, None].astype(np.uint32) if blocks else delta)
    if (width > 31).any():
        keep = width[row] < 32
        row, pos = row[keep], pos[keep]
    found = np.searchsorted(row, np.arange(blocks))
    index = np.zeros(blocks, [("low", "<u4"), ("width", "u1"), ("start", "<u8"), ("patch", "<u4")])
    index["low"], index["width"], index["start"], index["patch"] = low, width, starts[:-1], found
    patches = pos.astype("<u2").tobytes() + delta[row, pos].astype("<u4").tobytes()
    return index, body.tobytes() + patches


def unpack(index: np.ndarray, data: bytes, n_patches: int, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last``, or of all."""
    last = len(index) if last is None else last
    size = len(data) - 6 * n_patches
    body = np.frombuffer(data, np.uint8, size)
    pos = np.frombuffer(data, "<u2", n_patches, size)
    high = np.frombuffer(data, "<u4", n_patches, size + 2 * n_patches)
    part = index[first:last]
    grid = np.zeros((len(part), BLOCK), np.uint32)
    for w in np.unique(part["width"][part["width"] > 0]):
        of = np.flatnonzero(part["width"] == w)
        for j in range(int(w)):
            at = part["start"][of].astype(np.int64)[:, None] + j * (BLOCK // 8) + np.arange(BLOCK // 8)
            grid[of] |= np.unpackbits(body[at], axis=1).astype(np.uint32) << np.uint32(j)
    ends = np.append(index["patch"][1:], n_patches)[first:last].astype(np.int64)
    begins = part["patch"].astype(np.int64)
    if len(part) and ends[-1] > begins[0]:
        span = slice(begins[0], ends[-1])
        grid[np.repeat(np.arange(len(part)), ends - begins), pos[span]] = high[span]
    return (grid + part["low"][:, None]).reshape(-1)[: n - first * BLOCK]


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    index, data = pack(ids)
    n_patches = (len(data) - int(index["width"].astype(np.int64).sum()) * (BLOCK // 8)) // 6
    missing = np.array([d is None for d in doc_ids], bool)
    return b"".join([
        _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(index), n_patches),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.packbits(missing).tobytes(),
        np.array(lengths, "<u8").tobytes(),
        index.tobytes(),
        data,
    ])


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a segment."""
    magic, n_docs, n_ids, n_blocks, n_patches = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size
    docs = np.frombuffer(payload, "<i8", n_docs, at)
    at += 8 * n_docs
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, -(-n_docs // 8), at))[:n_docs]
    at += -(-n_docs // 8)
    lengths = np.frombuffer(payload, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    kind = np.dtype([("low", "<u4"), ("width", "u1"), ("start", "<u8"), ("patch", "<u4")])
    index = np.frombuffer(payload, kind, n_blocks, at)
    at += kind.itemsize * n_blocks
    ids = unpack(index, payload[at:], n_patches, n_ids)
    return [None if f else d for d, f in zip(docs.tolist(), flags.tolist())], lengths, ids


def write_token_files(docs: DataFrame, out: str, tokenizer: str = "byte_bpe_50k.json") -> None:
    """Encode ``doc_id, text`` in ascending doc_id order into segments under ``out``.

    The rows are dealt out by ranges of doc_id; each task writes one shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, shard = encoder(public_file(tokenizer)), TaskContext.get().partitionId()
        names, lengths, parts, count, segment, before = [], [], [], 0, 0, 0

        def flush():
            ids = np.concatenate(parts)
            row = (shard, segment, names[0], len(names), len(ids), before, write_segment(names, lengths, ids))
            return pa.RecordBatch.from_pylist([dict(zip(_SEGMENTS.names, row))], _SEGMENTS)

        for batch in text_slices(batches):
            with no_collections():
                ids, sizes = tool.encode(batch.column(1), END_ID)
            for key, part in zip(batch.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1])):
                names.append(key)
                parts.append(part)
                lengths.append(len(part))
                count += len(part)
                if count >= SEGMENT_IDS:
                    yield flush()
                    before += count
                    segment += 1
                    names, lengths, parts, count = [], [], [], 0
        if names:
            yield flush()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, SEGMENTS)
        .write.parquet(out)
    )


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    Only the totals of the shards are summed in one place; their number is that
    of the writing tasks.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard, before, payload = (batch.column(i)[0].as_py() for i in range(3))
            docs, lengths, ids = read_segment(payload)
            data = np.ascontiguousarray(ids, "<u4").tobytes()
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(docs), pa.int32()),
                    pa.array(docs, pa.int64()),
                    pa.array(ends - lengths + before, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                ],
                ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )

    segments = spark.read.parquet(out)
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        segments.groupBy("shard")
        .agg(F.min_by("first_doc", "segment").alias("first_doc"), F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    )
    return (
        segments.select("shard", "before", "payload")
        .mapInArrow(decode, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
        .join(shards, "shard")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
