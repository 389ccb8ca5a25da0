"""Near copies by SetSketch registers over word shingles.

A document's set is that of its distinct shingles, hashed to 64 bits. For each
of ``REGISTERS`` random orders the least exponential value over the set is kept
as a register: its exponent to the base ``BASE``, truncated to a byte. Sketches
of parts of a set merge by the greater value of each register, and sets with
likeness J agree in a register with a chance of at least J. Documents that
agree in a whole band of registers are candidates; the likelihood of the
register orders, given both set sizes, sets aside clearly unlike ones, and the
full sets decide.

With ``BANDS`` x ``ROWS`` = 64 x 8 registers a pair at the least linked likeness
of 0.8 misses all bands with a chance of 8e-6.

Nulls: a null text has no words; documents without words are linked with nothing.
Documents with equal sets form one class and are compared once. Rows with one
doc_id are one node. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm.common import slices
from cairn.llm.links import least_reachable
from cairn.session import Stages

BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.06, 4.0, 254
MARGIN = 0.09  # five standard errors of the estimate at 512 registers
STAR_BANDS = 16  # bands whose heads are met first; all bands count for what is left open
HEADS = 3  # rounds in which a document without a link meets one head
BITS = 1 << 25  # of the bitmap of wanted ids, 4 MB
PERCENT = 80
WORDS = [f"s{i}" for i in range(REGISTERS // 64)]  # the lowest bits of all registers
FINE = 4096  # further minima, of which one bit is kept, for documents with open questions
FINE_WORDS = [f"f{i}" for i in range(FINE // 64)]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_RANDOM = np.random.default_rng(20260112)
_FACTORS = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MORE_FACTORS = _RANDOM.integers(0, 1 << 32, FINE, dtype=np.uint32) | np.uint32(1)
_MORE_SHIFTS = _RANDOM.integers(0, 1 << 32, FINE, dtype=np.uint32)
_R = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit number for each word of the text, in order."""
    data = np.frombuffer(text.translate(_LOWER).encode("utf-8", "surrogatepass"), np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    # each byte is mixed with its place in the word; a word is the sum of its bytes
    starts = np.zeros(len(data), np.int64)
    starts[begin[1:]] = np.diff(begin)
    place = np.arange(len(data)) - begin[0] - np.cumsum(starts)
    mixed = _mix((data.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) * np.uint64(_R))
    mixed[gap] = 0
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    return _mix(total[end] - total[begin] + (end - begin).astype(np.uint64))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingles of ``size`` words; a shorter text is one shingle."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        joined = np.full(n, size, np.uint64)
        for k in range(size):
            joined = _mix(joined * np.uint64(_R) + words[k : k + n])
    return np.unique(joined)


def minima(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of a set in each of many random orders."""
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    rows = max(1, (1 << 16) // len(factors))
    for at in range(0, len(folded), rows):
        # the product's low half is mixed once more, its high half would need 64 bits
        x = folded[at : at + rows, None] * factors
        x += shifts
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes, one byte for each register."""
    low = minima(hashes, _FACTORS, _SHIFTS)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard likeness of rows of registers with known set sizes, on a grid of 1/50."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    best = np.full(len(a), -np.inf)
    found = np.zeros(len(a))
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    for j in np.arange(0, 1.001, 0.02):
        more, less = chance(u - v * j), chance(v - u * j)
        score = (
            above * np.log(np.maximum(more, 1e-9))
            + below * np.log(np.maximum(less, 1e-9))
            + equal * np.log(np.maximum(1 - more - less, 1e-9))
        )
        better = score > best
        best[better], found[better] = score[better], j
    return found


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, same_a, same_b, registers, s0..s7``: equal sets agree in both numbers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, one, two, regs, low = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_hashes(text, size)
                counts.append(len(found))
                one.append(int(_mix(found).sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(_mix(found * np.uint64(_R) + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                own = registers(found)
                regs.append(own.tobytes() if len(found) else None)
                low.append(np.packbits(own & 1).view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (counts, one, two)], pa.array(regs, pa.binary()), *map(pa.array, np.array(low).T)],
                ["doc_id", "n_shingles", "same_a", "same_b", "registers", *WORDS],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, same_a long, same_b long, registers binary, " + ", ".join(f"{w} long" for w in WORDS)
    )


def near_enough(percent: int, a: str, b: str, words: list[str] = WORDS, errors: float = 5) -> Column:
    """Whether sizes and kept bits allow a pair to be linked.

    Unequal minima differ in their bit half of the time. The bound lies some
    standard errors above what the least linked likeness gives.
    """
    p, n = (1 - percent / 100) / 2, 64 * len(words)
    most = int(n * p + errors * (n * p * (1 - p)) ** 0.5) + 1
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")
    return sizes & (unlike_bits(a, b, words) <= most)


def unlike_bits(a: str, b: str, words: list[str] = WORDS) -> Column:
    return sum((F.bit_count(F.col(a + w).bitwiseXOR(F.col(b + w))) for w in words), F.lit(0))


def fine_bits(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, f0..f63``: one bit of each of ``FINE`` minima."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = [np.packbits(minima(shingle_hashes(t, size), _MORE_FACTORS, _MORE_SHIFTS) & 1).view("<i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.array(bits).T)], ["doc_id", *FINE_WORDS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, " + ", ".join(f"{w} long" for w in FINE_WORDS))


def sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, members``: the distinct hashes of a set."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [shingle_hashes(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "members"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(gather, "doc_id long, members array<long>")


def bands(kept: DataFrame) -> DataFrame:
    """``band, k, doc_id``: one row for each band of a document's registers."""
    starts = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return kept.select("doc_id", "registers", F.explode(starts).alias("k")).select(
        F.xxhash64("k", F.substring("registers", F.col("k") * ROWS + 1, F.lit(ROWS))).alias("band"), "k", "doc_id"
    )


def chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among the distinct ``ids``.

    A bitmap of hashed ids, of ``BITS`` bits at most and so of a known size, goes
    to every task first and keeps most other rows out of the shuffle.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "bucket").filter(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1)
    return marked.select(*rows.columns).join(ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, kept: DataFrame, docs: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame:
    """The pairs ``a, b`` whose sets are alike enough: first by the likelihood of both sketches, then by the full sets."""
    floor = percent / 100 - MARGIN

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 1000):
                p = f.iloc[at : at + 1000]
                x, y = (np.frombuffer(b"".join(p[c]), np.uint8).reshape(len(p), REGISTERS) for c in ("ra", "rb"))
                j = likeness(x, y, p["na"].to_numpy(float), p["nb"].to_numpy(float))
                yield p.loc[j >= floor, ["a", "b"]]

    ends = lambda p: p.select(F.col("a").alias("doc_id")).unionByName(p.select(F.col("b").alias("doc_id"))).distinct()
    held = chosen(kept.select("doc_id", "registers", "n_shingles"), stages.cut(ends(pairs)))
    side = lambda c: held.select(F.col("doc_id").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    candidates = stages.cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(likely, "a long, b long"))
    full = stages.cut(sets(chosen(docs, stages.cut(ends(candidates))), size))
    return (
        candidates.join(full.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a")
        .join(full.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")
        .withColumn("both", F.size(F.array_intersect("ma", "mb")))
        .filter(100 * F.col("both") >= percent * (F.size("ma") + F.size("mb") - F.col("both")))
        .select("a", "b")
    )


def near_copies(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every distinct doc_id.

    A bucket has three heads. In each of three rounds every document that has no
    link yet meets one of them, the head of most of its buckets, so a round takes
    one pair a document. What these links join is one component; then only
    members of different components of a bucket meet, so that no link between
    components is lost.
    """
    stages = Stages(docs.sparkSession)
    every = stages.cut(sketches(docs, size))
    classes = every.filter("n_shingles > 0").groupBy("n_shingles", "same_a", "same_b").agg(F.min("doc_id").alias("first"))
    classes = stages.cut(classes)
    kept = stages.cut(
        every.filter("n_shingles > 0").join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    )
    rows = bands(kept)
    several = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("band")
    shared = stages.cut(rows.join(several, "band", "left_semi"))
    # three heads for each bucket: its least and greatest id, and one that differs from bucket to bucket
    heads = shared.groupBy("band").agg(
        F.array(F.min("doc_id"), F.max("doc_id"), F.min(F.struct(F.xxhash64("band", "doc_id"), "doc_id"))["doc_id"]).alias("heads")
    )
    heads = stages.cut(heads)
    brief = lambda side: kept.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"{side}n"), *[F.col(w).alias(side + w) for w in WORDS])
    alone = shared.filter(F.col("k") < STAR_BANDS)
    links, tries = [], []
    for turn in range(HEADS):
        met = alone.join(heads.select("band", F.col("heads")[turn].alias("a")), "band").filter("doc_id <> a")
        met = met.groupBy(F.col("doc_id").alias("b")).agg(F.mode("a", True).alias("a"))
        tries.append(stages.cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        fits = tries[-1].join(brief("a"), "a").join(brief("b"), "b").filter(near_enough(percent, "a", "b")).select("a", "b")
        links.append(stages.cut(confirmed(stages.cut(fits), kept, docs, size, percent, stages)))
        linked = links[-1].select(F.col("a").alias("doc_id")).unionByName(links[-1].select(F.col("b").alias("doc_id"))).distinct()
        if turn + 1 < HEADS:
            alone = stages.cut(alone.join(linked, "doc_id", "left_anti"))
    first, tried = (reduce(DataFrame.unionByName, x) for x in (links, tries))
    first = first.distinct()
    labels = least_reachable(first, stages)
    marked = (
        shared.join(labels.select(F.col("node").alias("doc_id"), "least"), "doc_id", "left")
        .select("band", "k", "doc_id", F.coalesce("least", "doc_id").alias("label"))
    )
    mixed = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    open_ = stages.cut(marked.join(mixed, "band", "left_semi"))
    ids = stages.cut(open_.select("doc_id").distinct())
    fine = fine_bits(chosen(docs, ids), size).dropDuplicates(["doc_id"])
    facts = stages.cut(kept.select("doc_id", F.col("n_shingles").alias("n"), "registers").join(fine, "doc_id"))
    side = lambda s: open_.join(facts, "doc_id").select("band", "k", *[F.col(c).alias(s + c) for c in ("doc_id", "label", "n", "registers", *FINE_WORDS)])
    part = lambda c, k: F.substring(c, k * ROWS + 1, F.lit(ROWS))
    x, y = side("x"), side("y").drop("k")
    # two documents may share many bands: the first one tells
    known = F.exists(F.sequence(F.lit(0), F.col("k")), lambda k: (k < F.col("k")) & (part(F.col("xregisters"), k) == part(F.col("yregisters"), k)))
    across = (
        x.join(y, (x["band"] == y["band"]) & (F.col("xlabel") < F.col("ylabel")) & near_enough(percent, "x", "y", FINE_WORDS, 4.5) & ~known)
        .select(F.least("xdoc_id", "ydoc_id").alias("a"), F.greatest("xdoc_id", "ydoc_id").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    second = confirmed(stages.cut(across), kept, docs, size, percent, stages)
    links = stages.cut(first.unionByName(second))
    final = least_reachable(links, stages).select(F.col("node").alias("first"), "least")
    ends = classes.join(final, "first", "left").select("n_shingles", "same_a", "same_b", F.coalesce("least", "first").alias("component_id"))
    return (
        every.select("doc_id", "n_shingles", "same_a", "same_b")
        .join(ends, ["n_shingles", "same_a", "same_b"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
