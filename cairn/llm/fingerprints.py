"""SimHash fingerprints, and all pairs of them within a Hamming radius.

Every distinct word of a text votes with its hash: each of 128 bits of the hash
adds or takes the word's weight. Long words are rare ones: a word weighs its
letters less three, and one at least. A fingerprint has the bits whose votes are
above zero. Votes for two bits travel in one long, so a text is a group of 64
sums that are made before anything is shuffled.

Nulls: a null text is an empty one; without words all bits are zero. Equal texts
have equal fingerprints. Rows with one doc_id, or with none (these come first),
are taken in the order of their texts, and each gives a row. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.llm.common import lower_ascii, partitions
from cairn.session import Stages

GAPS = r"[\s\p{Punct}]+"
HEX = 32  # hex digits of a fingerprint
FIRST = -(1 << 63)  # stands for a missing doc_id, before all others
BLOCKS = 6
RANGES = 4096  # at most so many ranges of ids, as their bounds are part of the plan


def distinct_words(text: Column) -> Column:
    """The words to vote, and an empty one that has no weight."""
    return F.array_union(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), F.array(F.lit("")))


def voted(words: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, high, low``: the fingerprints of groups of ``word`` rows."""
    weight = F.when(F.col("word") == "", 0).otherwise(F.greatest(F.lit(1), F.length("word") - 3)).cast("long")
    one = F.lit(1).cast("long")
    hashed = words.select(*keys, weight.alias("w"), F.xxhash64("word").alias("h0"), F.xxhash64("word", F.lit(1)).alias("h1"))

    def lane(h: str, i: int) -> Column:
        pair = F.shiftrightunsigned(h, i).bitwiseAND(one) + F.shiftleft(F.shiftrightunsigned(h, i + 32).bitwiseAND(one), 32)
        return F.sum(pair * F.col("w")).alias(f"{h}_{i}")

    def bits(h: str) -> Column:
        found = F.lit(0).cast("long")
        for i in range(32):
            sums = F.col(f"{h}_{i}")
            for bit, ones in ((i, sums.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(sums, 32))):
                found = found.bitwiseOR(F.when(2 * ones > F.col("w"), F.shiftleft(one, bit)).otherwise(F.lit(0).cast("long")))
        return found

    sums = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *[lane(h, i) for h in ("h0", "h1") for i in range(32)])
    return sums.select(*keys, bits("h0").alias("high"), bits("h1").alias("low"))


def as_hex(high: str, low: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), HEX // 2, "0"), F.lpad(F.hex(low), HEX // 2, "0")))


def differing(a: str, b: str) -> Column:
    """Hamming distance of the fingerprints named by two column prefixes."""
    return F.bit_count(F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high"))) + F.bit_count(F.col(f"{a}low").bitwiseXOR(F.col(f"{b}low")))


def in_order(docs: DataFrame) -> DataFrame:
    """Adds to each row the text, id and text hash of the next one in doc_id order; after the last comes the first.

    Ids are cut into ranges with about equally many rows. The first rows of a
    range are repeated in the range before it, so no range needs another.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order.alias("o"))
    n = min(RANGES, 2 * partitions(docs.sparkSession))
    cuts = rows.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("o"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted(rows.groupBy("bucket").agg(F.min("o").alias("o")).collect())
    if not firsts:
        return rows.withColumns({"rn": F.lit(1), "next_text": F.lit(""), "next_o": F.lit(0).cast("long"), "next_hash": F.lit(0).cast("long")})
    heads = F.create_map(*[F.lit(x) for b, o in firsts for x in (b, o)])
    priors = F.create_map(*[F.lit(x) for (b, _), (p, _) in zip(firsts, firsts[-1:] + firsts[:-1]) for x in (b, p)])
    own, before = heads[F.col("bucket")], priors[F.col("bucket")]
    places = F.when(
        F.col("o") == own,
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost")), F.struct(before.alias("bucket"), F.lit(1).alias("ghost"))),
    ).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))))
    placed = rows.select("doc_id", "text", "o", F.explode(places).alias("p")).select("doc_id", "text", "o", "p.bucket", "p.ghost")
    w = Window.partitionBy("bucket").orderBy("ghost", "o", "text")
    return (
        placed.withColumn("rn", F.row_number().over(w))
        .withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_o", F.lead("o").over(w))
        .filter("ghost = 0")
        .withColumn("next_hash", F.xxhash64("next_text"))
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    stages = Stages(docs.sparkSession)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(next_text, 1, half)"))
    rows = (
        in_order(docs)
        .withColumn("n_chars", n)
        .withColumn("half", half)
        .select("bucket", "rn", "doc_id", "o", "next_o", "next_hash", "n_chars", F.xxhash64("text").alias("hash"), "text", edited.alias("edited"))
    )
    keys = ["bucket", "rn", "doc_id", "o", "hash", "next_o", "next_hash", "n_chars", "edited_sha256", "which"]
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    words = (
        rows.withColumn("edited_sha256", F.sha2("edited", 256))
        .select(*keys[:-1], F.explode(both).alias("b"))
        .select(*keys[:-1], "b.which", F.explode(distinct_words(F.col("b.t"))).alias("word"))
    )
    prints = stages.cut(voted(words, keys))
    texts = prints.filter("which = 0").drop("which", "edited_sha256")
    changed = prints.filter("which = 1").select("bucket", "rn", "edited_sha256", F.col("high").alias("ehigh"), F.col("low").alias("elow"))
    following = texts.select(F.col("o").alias("next_o"), F.col("hash").alias("next_hash"), F.col("high").alias("nhigh"), F.col("low").alias("nlow")).distinct()
    return (
        texts.join(changed, ["bucket", "rn"])
        .join(following, ["next_o", "next_hash"])
        .select(
            "doc_id",
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            as_hex("high", "low").alias("fingerprint"),
            as_hex("ehigh", "elow").alias("edited_fingerprint"),
            (1 - differing("", "e") / 128.0).alias("near_edited"),
            (1 - differing("", "n") / 128.0).alias("near_next"),
        )
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, high, low`` of every distinct row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return voted(rows.select("doc_id", "hash", F.explode(distinct_words(F.col("text"))).alias("word")), ["doc_id", "hash"]).drop("hash")


def within(prints: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints at most ``radius`` bits apart, and who has which fingerprint.

    The bits are cut into ``blocks``; two fingerprints that near agree in at
    least ``blocks - radius`` of them. For each choice of so many blocks a table
    keyed by them finds every such pair. Returns ``a, b, distance`` between the
    least doc_ids of the fingerprints, and ``doc_id, class``.
    """
    if not 0 < radius < blocks:
        raise ValueError("radius must be at least 1 and less than the number of blocks")
    classes = prints.groupBy("high", "low").agg(F.min("doc_id").alias("class"))
    members = prints.join(classes, ["high", "low"]).select("doc_id", "class")
    text = as_hex("high", "low")
    cuts = [HEX * i // blocks for i in range(blocks + 1)]
    keyed = [
        F.struct(F.lit(k).alias("k"), F.concat_ws("", *[F.substring("hex", cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in chosen]).alias("part"))
        for k, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]
    tables = classes.withColumn("hex", text).select("class", "high", "low", F.explode(F.array(*keyed)).alias("t")).select("class", "high", "low", F.xxhash64("t.k", "t.part").alias("key"))
    a = tables.select("key", F.col("class").alias("a"), F.col("high").alias("ahigh"), F.col("low").alias("alow"))
    b = tables.select("key", F.col("class").alias("b"), F.col("high").alias("bhigh"), F.col("low").alias("blow"))
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (differing("a", "b") <= radius))
    return pairs.select("a", "b", differing("a", "b").alias("distance")).distinct(), members
