"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the words of a clause one after the other and pass
their states on: insults (learned words and word beginnings, each with a weight),
threats, targets, negation and reported speech. A matched clause has a weight:
that of its insults and threats, more if it has a target, less if a negation
stands just before the match or if the words are reported. A text's features
are built from its matched clauses, and a logistic curve turns them into a score.

Learning takes at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id. A
feature counts once per group of texts that share their three least word hashes,
so copies of a text are no evidence of their own.

Nulls: a null text is an empty one, rows without doc_id are scored and never
learned from. Labels that repeat count as the greatest one. Without labels of
both kinds every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cairn.llm.common import slices

SAMPLE = 20_000
LEXICON = 5_000  # the heaviest insults kept
PREFIXES = (3, 4, 5)
LEAST_BOUND = 1.2
REJECT = 0.7
FOLDS, HELD_OUT = 3, 1

# fixed values: function words that the grammar knows
TARGETS = [
    "you", "your", "yours", "yourself", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "euch",
    "sie", "tu", "te", "toi", "vous", "il", "elle", "ils", "usted", "ustedes", "ellos", "ella",
]
NEGATIONS = [
    "not", "no", "never", "nor", "isn", "aren", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun",
    "nunca", "ni",
]
REPORTS = [
    "said", "says", "say", "called", "calls", "quoted", "wrote", "sagte", "sagt", "nannte", "dit", "disait", "dijo",
    "dice",
]
THREATS = [
    "kill", "hurt", "destroy", "murder", "shoot", "beat", "töten", "schlagen", "tuer", "frapper", "matar", "golpear",
]
LINKS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "such", "so", "ein", "eine", "der", "die", "das", "un", "une",
    "le", "la", "el", "los", "que", "est", "es", "t",
]

TARGETED, NEGATED, REPORTED, THREAT = 1.25, 0.5, 0.7, 3.0
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_BREAKS = frozenset(".!?;:\n")
_KINDS = {w: k for k, words in (("target", TARGETS), ("no", NEGATIONS), ("report", REPORTS), ("threat", THREATS), ("link", LINKS)) for w in words}


class Weights(dict):
    """Insult weight of a word, worked out once: the whole word's, or that of its longest known beginning."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        found = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.lexicon.get(word[:n] + "*", 0.0))
        self[word] = found
        return found


def clause_weights(tokens: list[str], weights: Weights) -> list[float]:
    """The weights of the matched clauses of a text, in order."""
    found: list[float] = []
    insult = threat = 0.0
    target = negated = reported = False
    for token in [*tokens, "."]:
        if token in _BREAKS:
            if insult or threat and target:
                found.append((insult + threat) * (TARGETED if target else 1) * (REPORTED if reported else 1))
            insult = threat = 0.0
            target = negated = reported = False
            continue
        kind = _KINDS.get(token)
        weight = weights[token]
        if weight:
            insult += weight * (NEGATED if negated else 1)
        elif kind == "threat":
            threat += THREAT * (NEGATED if negated else 1)
        elif kind == "target":
            target = True
        elif kind == "report":
            reported = True
        # a negation reaches over articles and forms of "to be" only
        negated = kind == "no" or negated and kind == "link"
    return found


def features(text: str | None, weights: Weights) -> tuple[float, float, float, float]:
    """Heaviest clause, sum of clauses, number of clauses, and weight for the text's length."""
    tokens = _TOKEN.findall((text or "").lower())
    if not any(weights[t] or _KINDS.get(t) == "threat" for t in set(tokens)):
        return 0.0, 0.0, 0.0, 0.0
    found = clause_weights(tokens, weights)
    total = float(np.log1p(sum(found)))
    return max(found, default=0.0), total, float(np.log1p(len(found))), 3 * total / float(np.log(2 + len(tokens)))


@dataclass
class Model:
    lexicon: dict[str, float]
    curve: list[float] | None

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.curve is None or not len(rows):
            return np.zeros(len(rows))
        z = self.curve[0] + rows @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def _log_odds(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """A lower bound of the log odds: two standard errors below."""
    gap = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1))
    return gap - 2 * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic``: at most about ``sample`` rows outside the held-out fold."""
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(fold(F.col("doc_id")) != HELD_OUT)
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    return docs.select("doc_id", "text").join(known, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and curve from labelled rows; what reaches the driver is bounded by ``LEXICON`` and ``sample``."""
    rows = training_rows(docs, labels, sample)
    words = F.array_distinct(F.split(F.lower("text"), r"[\P{L}]+"))
    rare = F.array_sort(F.transform(F.filter(words, lambda w: F.length(w) >= 6), lambda w: F.xxhash64(w)))
    grouped = rows.select("toxic", F.xxhash64(F.slice(rare, 1, 3)).alias("group"), words.alias("words"))
    each = grouped.select("toxic", "group", F.explode("words").alias("w")).filter("w <> ''")
    starts = [F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in PREFIXES]
    found = each.select("toxic", "group", F.explode(F.array("w", *starts)).alias("f")).filter("f is not null").distinct()
    groups = dict(grouped.select("toxic", "group").distinct().groupBy("toxic").count().collect())
    toxic, clean = groups.get(1, 0), groups.get(0, 0)
    if not toxic or not clean:
        return Model({}, None)
    counted = found.groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    heavy = (
        counted.filter(F.col("t") >= max(3, 0.01 * toxic))
        .withColumn("b", _log_odds(F.col("t"), F.col("c"), toxic, clean))
        .filter(F.col("b") >= LEAST_BOUND)
        .orderBy(F.desc("b"), "f")
        .limit(LEXICON)
    )
    lexicon = {r.f: r.b for r in heavy.select("f", "b").collect()}
    seen = featured(rows, lexicon, ["toxic"]).toPandas()
    x, y = seen[["heaviest", "total", "clauses", "share"]].to_numpy(float), seen["toxic"].to_numpy(float)
    return Model(lexicon, fit(x, y))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Ridge logistic regression by Newton steps; the rows are sorted first, so their order does not matter."""
    order = np.lexsort([*x.T, y])
    a, y = np.c_[np.ones(len(x)), x][order], y[order]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * np.r_[0, w[1:]]
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), slope)
    return w.tolist()


def featured(rows: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """The kept columns and the four features of ``text``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in slices(batches):
            made = np.array([features(t, weights) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(made[:, i]) for i in range(4)]], [*keep, "heaviest", "total", "clauses", "share"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "text").mapInArrow(read, f"{kept}, heaviest double, total double, clauses double, share double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column ``score`` from 0 to 1; it has ``_`` behind it while that name is taken."""
    name = "score"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")
    lexicon, curve = model.lexicon, model.curve

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, own = Weights(lexicon), Model(lexicon, curve)
        for batch in slices(batches):
            made = np.array([features(t, weights) for t in batch.column(at).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.score(made))], [*batch.schema.names, name])

    return docs.mapInArrow(read, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of documents."""
    model = learn(docs, labels, sample)
    score = scored(docs.select("doc_id", "text"), model)
    return score.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    marked = scored(docs, learn(docs, labels, sample))
    name = marked.columns[-1]
    return marked.filter(F.col(name) < REJECT).drop(name)
