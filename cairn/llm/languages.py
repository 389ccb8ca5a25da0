"""Language by the nearest of several centroids per language.

A text is a vector of hashed 1- to 3-grams of bytes, in lower case and with every
run of non-letters as one blank, weighted by TF-IDF and normalised. Each language
has ``CLUSTERS`` centroids, found by spherical k-means. The language of the
centroid with the greatest cosine wins. A text that is farther from it than all
but ``FAR`` percent of its training texts is marked as rejected.

Training takes at most ``SAMPLE`` rows with a language outside the held-out fold,
chosen by a hash of doc_id.

Nulls: texts that are null or have no letter are ``und`` with score 0. Rows
without doc_id are judged and never learned from. Without rows to learn from
every text is ``und``. Every row gives a row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm.common import slices

SAMPLE = 2_000
SHARE = 20  # rows of a language that the sample holds at least, if there are so many
CLUSTERS = 4
FAR = 1.0
BUCKETS = 1 << 13
FOLDS, HELD_OUT = 5, 0

_CLASS = np.full(256, 32, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams."""
    data = _CLASS[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    blank = data == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    data = data[keep].astype(np.uint32)
    found = np.bincount(data, minlength=256).astype(np.float32)
    two = data[:-1] << 8 | data[1:]
    three = two[:-1] << 8 | data[2:]
    vector = np.zeros(BUCKETS, np.float32)
    vector[:256] = found
    for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
        # the upper bits of the product, in the places behind the single bytes
        hashed = (grams * np.uint32(salt)) >> np.uint32(16)
        vector += np.bincount(256 + hashed % np.uint32(BUCKETS - 256), minlength=BUCKETS)
    return vector


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    points: np.ndarray  # a row for each centroid
    least: np.ndarray  # the cosine below which a text is rejected

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts(text)) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Centroids | None:
    """Centroids from labelled rows; the driver gets at most about ``sample`` vectors of 16 kB.

    Every language has an equal share of the sample and gives all its rows if they
    are fewer, so a rare language is learned at every size. A share is about ``SHARE``
    rows at least (one larger gives none by a chance of 2e-9), so of more than
    ``sample / SHARE`` languages the most frequent ones are learned, the first by name
    among equals.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).select("doc_id", "lang", "text")
    shares = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, sample // SHARE)).collect()
    if not shares:
        return None
    share = max(SHARE, sample // len(shares))
    sizes = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in shares], "lang string, n long"))
    known = known.join(sizes, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.col("n")) < share).select("doc_id", "lang", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [np.log1p(counts(t)).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "lang", "v"])

    rows = known.mapInArrow(read, "doc_id long, lang string, v binary").toPandas().sort_values(["doc_id", "lang"])
    if rows.empty:
        return None
    x = np.frombuffer(b"".join(rows["v"]), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = x * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    names, points, least = [], [], []
    for lang in sorted(rows["lang"].unique()):
        own = x[(rows["lang"] == lang).to_numpy()]
        for point, members in clusters(own, min(CLUSTERS, len(own))):
            names.append(lang)
            points.append(point)
            least.append(np.percentile(members @ point, FAR))
    return Centroids(names, idf, np.array(points, np.float32), np.array(least))


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spherical k-means from far-apart rows: the centroids and their rows."""
    points = [x.mean(axis=0)]
    while len(points) < k:
        points.append(x[np.max(x @ np.array(points).T, axis=1).argmin()])
    points = np.array(points)
    for _ in range(rounds):
        of = (x @ points.T).argmax(axis=1)
        points = np.array([x[of == i].mean(axis=0) if (of == i).any() else points[i] for i in range(k)])
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    of = (x @ points.T).argmax(axis=1)
    for i in range(k):
        if (of == i).any():
            yield points[i], x[of == i]


def languages(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores, far = [], [], []
            for text in batch.column(1).to_pylist():
                if model is None or not text or not any(map(str.isalpha, text)):
                    names.append("und"), scores.append(0.0), far.append(True)
                    continue
                cosines = model.points @ model.vector(text)
                best = int(cosines.argmax())
                names.append(model.languages[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
                far.append(bool(cosines[best] < model.least[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(read, "doc_id long, lang_pred string, score double, rejected boolean")
        .select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
    )
