import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontamination, fingerprints, lines, near_copies
from cairn.llm.common import maybe_among
from cairn.llm.links import least_reachable
from cairn.session import Stages

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_least_reachable(spark):
    values = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in values.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.least for r in least_reachable(spark.createDataFrame(links, "a long, b long"), Stages(spark)).collect()}
    want = groups({x for e in links for x in e}, links)
    assert got == {n: t for n, t in want.items() if n != t}


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_whole(documents, small, size):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, len(base), 7)]
    docs = small.unionByName(documents([" ".join(base), *near, None, "", "Hi", "hi", "  ", "A B", "a b", "x " * 300], range(10_001, 10_014)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {k: shingles(t, size) for k, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_copies.near_copies(docs, size).collect()}
    assert got == {k: (len(s), want[k], want[k] == k) for k, s in sets.items()}
    assert near_copies.near_copies(docs.limit(0), size).count() == 0


def test_near_copies_hot_group(documents):
    """Hundreds of different copies of one text: one component, few rows per member."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(150)] + [" ".join(base)] * 100
    got = near_copies.near_copies(documents(texts), 5).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_sketches_merge():
    values = np.random.default_rng(2)
    a, b = (values.integers(0, 1 << 62, 500).astype(np.uint64) for _ in range(2))
    both = near_copies.registers(np.concatenate([a, b]))
    assert (np.maximum(near_copies.registers(a), near_copies.registers(b)) == both).all()


def test_likelihood():
    values = np.random.default_rng(3)
    for share in (0.3, 0.8):
        k = int(2000 * share / (1 + share))
        x = values.integers(0, 1 << 62, 2000 - k).astype(np.uint64)
        a, b = x[:1000], x[1000 - k :]
        j = near_copies.likeness(
            near_copies.registers(a)[None], near_copies.registers(b)[None], np.array([1000.0]), np.array([float(len(b))])
        )[0]
        assert abs(j - share) < 0.08


def brute_contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for text in texts:
        own = words(text)
        hit, found = set(), set()
        for item, t in items:
            w = words(t)
            n = min(13, len(w))
            for k in range(len(w) - n + 1) if w else ():
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
        yield len(own), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("few", [200_000, 0])
def test_contamination(spark, documents, few):
    item = " ".join(f"w{i}" for i in range(20))
    items = [(1, item), (2, "Short item"), (3, item), (4, None), (5, ""), (6, "the"), (7, "the the")]
    texts = [
        "a " + item.upper() + " b", "w3," + item[item.index(" w4") :], " ".join(f"w{i}" for i in range(12)), "a short item; short item short",
        None, "", "the the the", "x " * 200 + "short item", "short item short item", "nothing here",
    ]
    docs = documents([*texts, texts[0]], [*range(9), None, 0]).withColumnRenamed("source", "item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench, small=few).collect())
    want = sorted((str(i), *b) for i, b in zip([*range(9), None, 0], brute_contamination([*texts, texts[0]], items)))
    assert got == want
    none = decontamination.contamination(docs, bench.limit(0), small=few).collect()
    assert len(none) == 11 and not any(r.n_hit or r.contaminated for r in none)


def test_fingerprints(documents):
    texts = ["alpha beta gamma delta epsilon", None, "", "alpha beta gamma delta epsilon", "x", "Ünï cödé tèxt", "word " * 20_000]
    docs = documents(texts, [10, 3, 4, 7, None, 9, 8])
    order = sorted(zip([10, 3, 4, 7, -1, 9, 8], [t or "" for t in texts]))
    got = {-1 if r.doc_id is None else r.doc_id: r for r in fingerprints.with_edits(docs).collect()}
    assert len(got) == 7 and got[10].fingerprint == got[7].fingerprint and got[3].fingerprint == got[4].fingerprint == "0" * 32
    import hashlib

    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[key].n_chars == len(text) and got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        near = 1 - bin(int(got[key].fingerprint, 16) ^ int(got[order[(i + 1) % len(order)][0]].fingerprint, 16)).count("1") / 128
        assert got[key].near_next == near and 0 <= got[key].near_edited <= 1
    assert fingerprints.with_edits(docs.limit(0)).count() == 0
    one = fingerprints.with_edits(docs.filter("doc_id = 10")).collect()
    assert one[0].near_next == 1


def test_fingerprints_within(spark):
    values = np.random.default_rng(5)
    prints, number = {}, 0
    for _ in range(30):
        base = int.from_bytes(values.bytes(16), "big")
        for flips in (0, 0, 1, 3, 4):
            x = base
            for bit in values.choice(128, flips, replace=False):
                x ^= 1 << int(bit)
            prints[number] = x
            number += 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(x >> 64), signed(x & (1 << 64) - 1)) for k, x in prints.items()]
    pairs, members = fingerprints.within(spark.createDataFrame(rows, "doc_id long, high long, low long"), 3)
    first = {}
    for k, x in prints.items():
        first.setdefault(x, k)
    want = {(a, b, (x ^ y).bit_count()) for (x, a), (y, b) in combinations(first.items(), 2) if (x ^ y).bit_count() <= 3}
    assert {(r.a, r.b, r.distance) for r in pairs.collect()} == want
    assert {(r.doc_id, r["class"]) for r in members.collect()} == {(k, first[x]) for k, x in prints.items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_segments():
    values = np.random.default_rng(6)
    for _ in range(800):
        a, b = ("".join(values.choice(list("abé"), n)) for n in values.integers(0, 9, 2))
        for most in (1, 2, 3):
            assert lines.edit_distance(a, b, most) == min(distance(a, b), most + 1)
    for _ in range(800):
        a = list(values.choice(list("abc"), values.integers(6, 14)))
        b = a[:]
        for _ in range(values.integers(0, 3)):
            k = int(values.integers(0, len(b)))
            b[k : k + int(values.integers(0, 2))] = list(values.choice(list("xy"), values.integers(0, 2)))
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if distance(a, b) <= 2:
            index = {(len(b), i, b[s : s + n]) for i, (s, n) in enumerate(lines.segments(len(b), 3))}
            assert any((t, i, a[s : s + n]) in index for t, i, s, n in lines.asked(len(a), 2))


def test_lines(documents):
    long = "this line is long enough to be looked at by the join"
    texts = [f"{long}\nshort\nan own line of the first document", f"own words of the second text\n{long}", f"{long[:-3]}axxm", long.replace("line", "liné"), None, "", f"{long}\n{long}\nshort", "short"]
    docs = documents(texts, [5, 6, 7, 8, 9, 10, 11, None])
    got = {r.doc_id: r for r in lines.judged(docs).collect()}
    gone, _ = lines.repeated(docs.select("doc_id", "text"))
    left = {r.doc_id: (r.text, r.emptied) for r in lines.without_lines(docs, gone).collect()}
    assert left == {
        5: (texts[0], False), 6: ("own words of the second text", False), 7: (texts[2], False), 8: ("", True), 9: (None, False),
        10: ("", False), 11: ("short", False), None: ("short", False),
    }
    assert (got[8].n_links, got[11].n_links, got[11].n_gone, got[7].n_links) == (1, 2, 2, 0)
    assert lines.judged(docs.limit(0)).count() == 0


def test_short_lines(documents):
    texts = ["Les.\nan own line of the first document", "Les.\n\n  \nAnd ornd.", "And ornd!\n\n  \nles.", "And ornd.", "x\nx"]
    docs = documents(texts, [5, 6, 7, 8, 9])
    got = {r.doc_id: (r.n_lines, r.n_links, r.n_gone, r.emptied) for r in lines.judged(docs, shortest=1).collect()}
    assert got == {5: (2, 0, 0, False), 6: (2, 0, 1, False), 7: (2, 0, 0, False), 8: (1, 0, 1, True), 9: (2, 0, 1, False)}
    gone, _ = lines.repeated(docs, shortest=1)
    left = {r.doc_id: r.text for r in lines.without_lines(docs, gone).collect()}
    assert left == {5: texts[0], 6: "\n  \nAnd ornd.", 7: texts[2], 8: "", 9: "x"}


def test_short_lines_of_the_query_and_the_stage(spark, tmp_path, documents):
    import __spark_entry__ as entry
    import corpus_pipeline

    documents(["Les.\nown words of the first text", "Les.\nother words of the second one"], [1, 2]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_gone for r in entry.queries()["op9_line_dedup"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    kept = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text.split("\n")[0] for r in kept.collect()} == {1: "Les.", 2: "other words of the second one"}


def edited(source, line, edits):
    """The line after so many edits of single characters at random places."""
    line = list(line)
    for _ in range(edits):
        k = source.randrange(len(line))
        line[k : k + source.randint(0, 1)] = source.choice(["", "x", "é", "1"])
    return "".join(line)


def test_pieces_of_long_lines_meet():
    source = random.Random(3)
    for n in (150, 199, 320, 1000):
        for _ in range(60):
            a = "".join(source.choice("abc d") for _ in range(n))
            b = edited(source, a, lines.bound(n, 2))
            a, b = sorted((a, b), key=len, reverse=True)
            own, at, h = lines.pieces(["ab", a, "", b], lines.common_run(2))
            one, other = ({(int(k), int(p)) for o, p, k in zip(own, at, h) if o == i} for i in (1, 3))
            assert set(own) <= {1, 3} and any(k == m and abs(p - q) <= lines.bound(n, 2) for k, p in one for m, q in other)


def test_bound_grows_with_the_line(documents):
    source = random.Random(4)
    words = [f"{''.join(source.choice('abcdefgh') for _ in range(source.randint(2, 9)))}" for _ in range(400)]
    texts = []
    for n in [8, 20, 30, 60, 100]:
        line = " ".join(source.choice(words) for _ in range(n))
        texts += [line, *(edited(source, line, k) for k in (1, 3, len(line) // 50, len(line) // 50 + 2))]
    got = {r.doc_id: r.n_links for r in lines.judged(documents(texts)).collect()}
    near = lambda a, b: a != b and distance(a, b) <= max(2, max(len(a), len(b)) // 50)
    want = {i: sum(near(a, b) for b in set(texts) if abs(len(a) - len(b)) < 60) for i, a in enumerate(texts)}
    assert got == want and sum(want.values()) > 20


def test_lines_of_crowded_keys(documents):
    """Many lines around one text, about half of them too far apart for a link: classes and links as by all pairs, meetings as few as keys."""
    source = random.Random(5)
    base = " ".join("".join(source.choice("abcdefgh") for _ in range(source.randint(2, 9))) for _ in range(40))
    short = "a line of less than seventy letters that many others repeat"
    texts = [edited(source, base, source.randint(1, 6)) for _ in range(150)] + [edited(source, short, source.randint(0, 3)) for _ in range(60)]
    docs = documents(texts)
    near = lambda a, b: a != b and lines.edit_distance(a, b, lines.bound(max(len(a), len(b)), 2)) <= lines.bound(max(len(a), len(b)), 2)
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if near(texts[i], texts[j])]
    first = groups(range(len(texts)), links + [(i, j) for i, j in combinations(range(len(texts)), 2) if texts[i] == texts[j]])
    assert 3 * len(links) < 2 * sum(near(a, a + "x") for a in texts) ** 2 / 2 and len(set(first.values())) > 2
    got = {r.doc_id: (r.n_links, r.n_gone) for r in lines.judged(docs).collect()}
    want = {i: (sum(near(t, u) for u in set(texts)), int(first[i] != i)) for i, t in enumerate(texts)}
    assert got == want
    rows = lines.keys(docs, 2, 20)
    met = lines.meetings(rows)
    assert 0 < met.count() < rows.count() and met.select("line", "head").distinct().count() < len(links)


def test_only_shared_keys_become_rows(documents):
    """Keys of one line alone take no row, a line that many tasks hold is one row first, and lines meet as by all keys."""
    source = random.Random(6)
    texts = ["".join(source.choice("abcdefgh ") for _ in range(source.choice([60, 400]))) for _ in range(80)]
    near = [edited(source, t, 2) for t in texts[:6]]
    docs = documents(texts + near + texts[-9:] * 4).repartition(8)
    every, few = lines.keys(docs, 2, 20), lines.shared_keys(docs, 2, 20, Stages(docs.sparkSession))
    met = [sorted({(r.key, r.line, r.head) for r in lines.meetings(x).collect()}) for x in (every, few)]
    assert met[0] == met[1] and len(met[0]) > 20
    assert few.count() < 3 * len(met[0]) < every.count() / 2


def test_texts_that_lose_no_line_are_not_shuffled(documents):
    source = random.Random(7)
    texts = ["an own line " + "".join(source.choice("abcdefgh") for _ in range(40)) for i in range(40)]
    docs = documents(texts + texts[:3])
    gone, _ = lines.repeated(docs)
    left = lines.without_lines(docs, gone)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and sum("Join LeftOuter" in x and "broadcast" not in x for x in plan.split("\n")) == 1
    flags = maybe_among(docs.withColumn("hash", F.xxhash64("text")), F.col("hash"), docs.filter("doc_id < 3").select(F.xxhash64("text").alias("hash")), "maybe")
    assert {r.doc_id for r in flags.filter("maybe").collect()} == {0, 1, 2, 40, 41, 42}
    assert sorted((r.doc_id, r.emptied) for r in left.collect()) == [(i, i >= 40) for i in range(43)]
