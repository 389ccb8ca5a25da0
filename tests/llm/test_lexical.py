"""Ranked search next to scores worked out one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cairn.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    bags = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in sorted(set(items), key=str):
        found = []
        for (doc_id, bag), size in zip(bags, sizes):
            m = 100 - 90 + (90 * size * n) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in set(words(text))
                if t in bag
            )
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, given, doc_id) in enumerate(sorted(found)[:10], 1):
            out.append((item_id, rank, doc_id if given else None, -score))
    return sorted(out, key=str)


def texts(count, seed, size=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(90)] + ["Ä", "ä", "a b"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [rnd.choice([" ", "-", "\n"]).join(rnd.choices(vocabulary, weights, k=rnd.randint(0, size))) for _ in range(count)]


def run(spark, documents, docs, items):
    table = documents([t for _, t in docs], ids=[i for i, _ in docs])
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", lexical.F.lit("clash"))
    return sorted((tuple(r) for r in lexical.ranked(table, asked).collect()), key=str)


def test_against_brute_force(spark, documents):
    docs = list(enumerate(texts(300, 1))) + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "+++")]
    docs += [(1000 + k, "W7 w8") for k in range(30)]  # ties over the tenth place
    items = list(enumerate(texts(12, 2, 200))) + [(3, "w7 W8"), (3, "w7 W8"), (None, "w1"), (50, None), (51, "unknown"), (52, "")]
    assert run(spark, documents, docs, items) == brute(docs, items)


def test_items_in_several_scans(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    docs, items = list(enumerate(texts(80, 3))), list(enumerate(texts(8, 4)))
    assert run(spark, documents, docs, items) == brute(docs, items)


def test_empty_tables(spark, documents):
    assert run(spark, documents, [], [(1, "w1")]) == []
    assert run(spark, documents, [(1, "w1")], []) == []
    assert run(spark, documents, [(1, None)], [(1, "w1")]) == []


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "PART", 7)
    for text in ("one two  three", "averyverylongword x", "a" * 50, "", "   ", "b c " * 20):
        assert [t.decode() for part in lexical.terms(text.encode()) for t in part] == words(text)


@pytest.mark.parametrize("wide", [3, 130])
def test_few_documents_are_scored(wide):
    """Masks that cannot reach the tenth place are left out, and the best stay the best."""
    rnd = np.random.default_rng(wide)
    block = lexical._Block()
    for k in range(500):
        held = Counter({int(t): 1 for t in rnd.choice(np.arange(1, wide + 1), rnd.integers(1, wide + 1), replace=False)})
        block.add(k, 20, held)
    row = block.row()
    flat = [c.flatten().to_numpy() for c in row.columns[:6]]
    m = np.full(500, 20)
    searched = lexical._Row(flat[0], m, flat[2], flat[3], flat[4], flat[5])
    seen = []
    inner = searched._scores
    searched._scores = lambda rows, held: seen.append(len(rows)) or inner(rows, held)
    item = lexical.Item(0, np.arange(1, wide + 1), np.arange(wide, 0, -1) * 100)
    best = lexical._Best()
    searched.search(item, best)
    scores = inner(np.arange(500), list(zip(item.terms.tolist(), item.weights.tolist())))
    want = sorted(zip((-scores).tolist(), range(500)))[:10]
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want
    assert sum(seen) < 250
