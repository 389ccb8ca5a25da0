"""Benchmark passages in documents: a prefix-filtered join with exact checks.

Words are hashed only to find candidates; every hit is confirmed on the words
themselves. Every window of an item (13 words, or the whole of a shorter item)
must lie in a document whole, so its prefix is one word: the one that is rarest
in the documents. Document words meet these prefixes, the word's place in the
window and both lengths bound where the window may start, and the slice of the
document there must equal the window.

Nulls: null texts have no words, null ids stay as they are (a null item_id is
counted as an item, and is left out of the list). Items with equal words share
their windows. Rows of documents with equal id and text give equal rows. Empty
tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.llm.common import lower_ascii
from cairn.session import Stages

WINDOW = 13
SHARE = 20  # a document is contaminated from 1/20 of its words
SMALL = 200_000  # prefix rows of at most ~200 bytes that may be sent to every task

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAPS), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``words`` of every distinct window, and the numbers ``item`` of the items that hold it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (size - 1)))
    return items.select("item_id", "all", F.explode(starts).alias("at")).select(
        "item_id", F.slice("all", F.col("at"), F.lit(size)).alias("words")
    )


def prefixes(docs: DataFrame, found: DataFrame, small: int = SMALL) -> DataFrame:
    """``h, at, words, wid``: the rarest word of each window, hashed, and its place there."""
    each = found.select("wid", "words", F.posexplode("words").alias("at", "word")).withColumn("h", F.xxhash64("word"))
    vocabulary = each.select("h").distinct()
    few = vocabulary.count() <= small
    counts = (
        docs.select(F.explode(words(F.col("text"))).alias("word"))
        .select(F.xxhash64("word").alias("h"))
        .join(F.broadcast(vocabulary) if few else vocabulary, "h")
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), "h", "at"))
    return (
        each.join(counts, "h", "left")
        .groupBy("wid")
        .agg(rarest.alias("r"), F.first("words").alias("words"))
        .select(F.col("r.h").alias("h"), F.col("r.at").alias("at"), "words", "wid")
    )


def occurrences(docs: DataFrame, keys: DataFrame, small: int = SMALL) -> DataFrame:
    """``key, start, n, wid``: every window that a document holds, with its start and length."""
    few = keys.count() <= small
    texts = docs.select("key", words(F.col("text")).alias("all"))
    fits = "start >= 0 and start + size(words) <= size(all) and slice(all, start + 1, size(words)) = words"
    if few:
        # the array of a document stays where it is: unfolding, join and check run in one stage
        met = texts.select("key", "all", F.posexplode("all").alias("pos", "word")).join(
            F.broadcast(keys), F.xxhash64("word") == F.col("h")
        )
    else:
        near = texts.select("key", F.posexplode("all").alias("pos", "word")).join(
            keys.select("h", "at", "wid"), F.xxhash64("word") == F.col("h")
        )
        met = (
            near.select("key", "pos", "at", "wid")
            .join(keys.select("wid", "words"), "wid")
            .join(texts.distinct(), "key")
        )
    return (
        met.withColumn("start", F.col("pos") - F.col("at"))
        .filter(fits)
        .select("key", "start", F.size("words").alias("n"), "wid")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE, small: int = SMALL) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key`` for every row of documents.

    ``small``: the most prefix rows that are broadcast; beyond it the joins shuffle.
    """
    stages = Stages(docs.sparkSession)
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")).alias("key")
    docs = docs.select("doc_id", "text", key)
    # one number for each distinct window, and the items that hold it
    raw = windows(benchmark, size)
    distinct = stages.cut(raw.groupBy("words").agg(F.lit(1).alias("one")).select(F.monotonically_increasing_id().alias("wid"), "words"))
    holders = raw.join(distinct, "words").select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    keys = stages.cut(prefixes(docs, distinct, small))
    hits = stages.cut(occurrences(docs, keys, small).distinct())

    spans = hits.groupBy("key", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    n_hit = (
        spans.select("key", end.alias("end"), F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))).alias("from"))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).cast("long").alias("n_hit"))
    )
    per_item = hits.select("key", "wid").distinct().join(holders, "wid").select("key", "item").distinct()
    named = per_item.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")
    )
    found = n_hit.join(named, "key").select(F.col("key").alias("k"), "n_hit", "n_items", "items")
    each = docs.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    hit, n = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n_words")
    return each.join(found, F.col("key").eqNullSafe(F.col("k")), "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= n)).alias("contaminated"), "key",
    )


SQL = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from benchmark),
i as (select item_id, least(len(w), {WINDOW}) n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') t from b, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) u(s) where len(w) > 0),
ln as (select distinct n from i),
p as (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') t from d, ln, unnest(range(1, len(w) - n + 2)) u(s) where len(w) >= n),
h as (select doc_id, s, p.n, item_id from p join i on p.t = i.t and p.n = i.n),
x as (select doc_id, count(distinct q) n_hit from h, unnest(range(s, s + n)) v(q) group by 1),
y as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) items from h group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) contaminated
from d left join x using (doc_id) left join y using (doc_id)
"""
