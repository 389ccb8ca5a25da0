"""The best documents of every item by weighted terms, through masks of present terms.

One scan writes an index: each row covers some thousand documents and holds, for
the terms of the items alone, which documents have them and how often. The counts
over all documents come from that index. The second job reads it: bitmap
operations give every document of a row its mask of an item's terms, documents of
one mask form a group, and groups are scored from the highest possible score down,
until the tenth best score found lies above what any further group can reach.

Nulls and texts without terms count nowhere. Every row of the documents counts,
also with a repeated id; rows without an id come first among equal scores. Equal
items count once, and different texts under one id are ranked each by itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.llm.common import slices
from cairn.session import Stages

BEST = 10
BLOCK_DOCS = 8192  # documents of one index row
BLOCK_POSTINGS = 1 << 20  # and pairs of document and term, one document more at most
ITEM_BYTES = 2_000_000  # text of the items that one scan serves; more items take more scans
SALTS = 64
PART = 1 << 20  # bytes of a text that are cut into terms at a time
NO_ID = -(2**63)

_KEPT = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))

_INDEX = "doc_id array<bigint>, n array<bigint>, term array<int>, holders array<int>, doc array<int>, tf array<bigint>, n_docs bigint, n_terms bigint"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a bounded part at a time."""
    at, size = 0, len(text)
    while at < size:
        to = at + PART
        part = text[at:to].translate(_FOLD)
        if to < size and (cut := part.rfind(b" ")) >= 0:
            part, to = part[:cut], at + cut + 1
        elif to < size:  # one term fills the part: go on to its end
            while to < size and _FOLD[text[to]] != 0x20:
                to += 1
            part = text[at:to].translate(_FOLD)
        yield part.split()
        at = to


class _Block:
    """Documents on their way into one index row."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[int] = []
        self.docs: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, size: int, held: Counter) -> None:
        self.docs += [len(self.ids)] * len(held)
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.terms += held.keys()
        self.counts += held.values()

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or len(self.docs) >= BLOCK_POSTINGS

    def row(self) -> pa.RecordBatch:
        term = np.array(self.terms, np.int32)
        order = np.argsort(term, kind="stable")
        present, holders = np.unique(term, return_counts=True)
        values = [
            pa.array(self.ids, pa.int64()),
            pa.array(self.sizes, pa.int64()),
            pa.array(present, pa.int32()),
            pa.array(holders, pa.int32()),
            pa.array(np.array(self.docs, np.int32)[order], pa.int32()),
            pa.array(np.array(self.counts, np.int64)[order], pa.int64()),
        ]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
        columns += [pa.array([sum(s > 0 for s in self.sizes)], pa.int64()), pa.array([sum(self.sizes)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])


def presence_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows of the index; ``vocabulary`` numbers the wanted terms from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, held = 0, Counter()
                for part in terms(text or b""):
                    size += len(part)
                    held.update(filter(None, map(vocabulary.get, part)))
                block.add(doc_id, size, held)
                if block.full():
                    yield block.row()
                    block = _Block()
        if block.ids:
            yield block.row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, _INDEX)


class Item(NamedTuple):
    place: int
    terms: np.ndarray  # numbers of its terms, the heaviest first
    weights: np.ndarray


class _Best:
    """The best documents of one item so far."""

    def __init__(self):
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this one changes nothing."""
        return int(self.scores[-1]) if len(self.scores) == BEST else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        order = np.lexsort((ids, -scores))[:BEST]
        self.scores, self.ids = scores[order], ids[order]


def _masks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of mask words, as the first row of each, and the group of every row."""
    _, group = np.unique(words[0], return_inverse=True)
    for word in words[1:]:
        _, more = np.unique(word, return_inverse=True)
        _, group = np.unique(group * (more.max() + 1) + more, return_inverse=True)
    _, first = np.unique(group, return_index=True)
    return first, group


class _Row:
    """One index row, searched item by item."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, term: np.ndarray, holders: np.ndarray, doc: np.ndarray, tf: np.ndarray):
        self.ids, self.m, self.doc, self.tf = ids, m, doc, tf
        ends = np.cumsum(holders)
        self.spans = {t: (e - h, e) for t, e, h in zip(term.tolist(), ends.tolist(), holders.tolist())}
        starts = (ends - holders).astype(np.int64)
        self.most = dict(zip(term.tolist(), np.maximum.reduceat(tf, starts).tolist())) if len(term) else {}
        self.least_m = int(m.min()) if len(m) else 0

    def search(self, item: Item, best: _Best) -> None:
        held = [(t, w) for t, w in zip(item.terms.tolist(), item.weights.tolist()) if t in self.spans]
        if not held:
            return
        most = np.array([self.most[t] for t, _ in held], np.int64)
        weights = np.array([w for _, w in held], np.int64)
        if int((weights * (1_000_000_000 * most // (1000 * most + 8 * self.least_m))).sum()) < best.least:
            return
        # the mask of every document, a bit a term
        words = np.zeros(((len(held) + 63) // 64, len(self.ids)), np.uint64)
        for j, (t, _) in enumerate(held):
            start, end = self.spans[t]
            words[j >> 6, self.doc[start:end]] |= np.uint64(1 << (j & 63))
        matched = np.flatnonzero(words.any(axis=0))
        first, group = _masks(words[:, matched])
        # what the documents of a mask can reach: the largest counts with the least length
        shortest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(shortest, group, self.m[matched])
        limit = np.zeros(len(first), np.int64)
        chosen = words[:, matched[first]]
        for j in range(len(held)):
            on = (chosen[j >> 6] >> np.uint64(j & 63) & np.uint64(1)).astype(np.int64)
            limit += on * weights[j] * (1_000_000_000 * most[j] // (1000 * most[j] + 8 * shortest))
        order = np.argsort(-limit, kind="stable")
        sizes = np.bincount(group, minlength=len(first))
        by_group = np.argsort(group, kind="stable")
        starts = np.cumsum(sizes) - sizes
        at = 0
        while at < len(order) and limit[order[at]] >= best.least:
            # some masks at a time, as many as make a useful batch of documents
            to = at + 1 + int(np.searchsorted(np.cumsum(sizes[order[at:]]), 4 * BEST))
            masks = [g for g in order[at:to].tolist() if limit[g] >= best.least]
            rows = matched[np.concatenate([by_group[starts[g] : starts[g] + sizes[g]] for g in masks])]
            best.add(self._scores(rows, held), self.ids[rows])
            at = to

    def _scores(self, rows: np.ndarray, held: list[tuple[int, int]]) -> np.ndarray:
        scores = np.zeros(len(rows), np.int64)
        order = np.argsort(rows)
        rows = rows[order]
        for t, w in held:
            start, end = self.spans[t]
            docs = self.doc[start:end]
            place = np.minimum(np.searchsorted(docs, rows), len(docs) - 1)
            hit = np.flatnonzero(docs[place] == rows)
            tf = self.tf[start:end][place[hit]]
            scores[hit] += w * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[rows[hit]]))
        back = np.empty_like(scores)
        back[order] = scores
        return back


def _searched(index: DataFrame, items: list[Item], n_docs: int, n_terms: int) -> DataFrame:
    """``place, doc_id, score``: the best of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i.place: _Best() for i in items}
        for batch in slices(batches, 1):
            ids, n, term, holders, doc, tf = (c.flatten() for c in batch.columns[:6])
            m = 100 - 90 + (90 * n.to_numpy() * n_docs) // n_terms
            row = _Row(ids.fill_null(NO_ID).to_numpy(), m, term.to_numpy(), holders.to_numpy(), doc.to_numpy(), tf.to_numpy())
            for item in items:
                row.search(item, best[item.place])
        for place, found in best.items():
            if len(found.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.ids), place), pa.int64()), pa.array(found.ids), pa.array(found.scores)],
                    ["place", "doc_id", "score"],
                )

    return index.mapInArrow(run, "place long, doc_id long, score long")


def _top(found: DataFrame, *keys: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= BEST)


def _numbered(texts: Iterable[str | None]) -> tuple[dict[bytes, int], list[list[int]]]:
    """A number for every term of the items, and the terms of each item."""
    numbers: dict[bytes, int] = {}
    held = [
        sorted({numbers.setdefault(t, len(numbers) + 1) for part in terms((text or "").encode()) for t in part})
        for text in texts
    ]
    return numbers, held


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: up to ten documents with a score above 0 for every item."""
    spark = docs.sparkSession
    stages = Stages(spark)
    asked = stages.cut(items.select("item_id", F.col("text").cast("string").alias("text")).distinct())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size) // ITEM_BYTES + 1
    parts = [asked] if blocks == 1 else [asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]
    results = []
    for part in parts:
        rows = part.collect()  # about ITEM_BYTES of text
        vocabulary, held = _numbered(r.text for r in rows)
        index = stages.cut(presence_index(docs, vocabulary))
        totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = int(totals[0] or 0), int(totals[1] or 0)
        pairs = index.select(F.explode(F.arrays_zip("term", "holders")).alias("p")).groupBy("p.term").agg(F.sum("p.holders").alias("df"))
        df = {r.term: int(r.df) for r in pairs.collect()}  # one row a term of the items
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
        wanted = []
        for place, numbers in enumerate(held):
            use = sorted((t for t in numbers if t in weight), key=lambda t: -weight[t])
            wanted.append(Item(place, np.array(use, np.int64), np.array([weight[t] for t in use], np.int64)))
        found = _searched(index, [i for i in wanted if len(i.terms)], n_docs, max(n_terms, 1))
        found = _top(found, F.col("place"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).drop("rank")
        kind = asked.schema["item_id"].dataType.simpleString()
        places = spark.createDataFrame([(p, r.item_id) for p, r in enumerate(rows)], f"place long, item_id {kind}")
        doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
        results.append(_top(found, F.col("place")).join(places, "place").select("item_id", "rank", doc_id.alias("doc_id"), "score"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""
with items as (select row_number() over () as place, * from (select distinct item_id, text from benchmark)),
asked as (select distinct place, unnest({_TERMS}) as term from items),
docs as (select row_number() over () as k, doc_id, {_TERMS} as terms from documents),
sizes as (select k, doc_id, len(terms) as n from docs where len(terms) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
held as (
  select k, term, count(*) as tf from (select k, unnest(terms) as term from docs)
  where term in (select term from asked) group by k, term),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from held group by term), total),
scored as (
  select place, k, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::bigint as score
  from asked join held using (term) join weights using (term) join sizes using (k), total
  group by place, k, doc_id),
best as (
  select *, row_number() over (partition by place order by score desc, doc_id nulls first) as r from scored where score > 0)
select item_id, r::int as rank, doc_id, score from best join items using (place) where r <= 10
"""
