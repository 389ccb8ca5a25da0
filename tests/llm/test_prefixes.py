"""The trie of conversations next to sets of members worked out one by one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cairn.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        group = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(group, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[n] for n in below) if below else 1
        saved[node] = sum(saved[n] for n in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(held), len(node), parent, len(held), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def made(seed, convs, turns, texts):
    rnd = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rnd.randint(1, turns)):
            rows.append((c, t, rnd.choice(["user", "assistant"][: 1 + seed % 2]), rnd.choice(texts)))
    rnd.shuffle(rows)
    return rows


def check(spark, rows, **sizes):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("depth", prefixes.F.lit("clash"))
    assert sorted((tuple(r) for r in prefixes.trie(table, **sizes).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = made(seed, list(range(150)) + [-3, -100, -105, 100_000_000_000], 8, ["", "a", "ü b", "c" * 50])
    rows += [(7, None, None, None), (7, None, "user", "x"), (7, 2, "user", "x"), (7, 2, "user", "x"), (None, 0, "user", "x"), (450, 0, "user", "no group")]
    check(spark, rows)


def test_long_conversations_in_small_parts(spark):
    """Conversations that reach over many rows, tasks and tries."""
    rows = made(4, range(100, 130), 40, ["a"]) + made(5, [200, 201, 300], 300, ["a", "b"])
    rows += [(c, t, "user", "a") for c in (401, 402, 403) for t in range(400)]
    check(spark, rows, part_turns=7, trie_turns=50)
    check(spark, rows, part_turns=3, trie_turns=20)


def test_copies_share_all_nodes(spark):
    check(spark, [(c, t, "user", f"turn {t}") for c in range(0, 4000, 10) for t in range(6)])


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            best = max(range(low + 1, high + 1), key=lambda n: n & -n)
            assert prefixes.two_fattest(low, high) == best


def test_place_where_a_path_leaves():
    """The search over two-fattest depths finds the depth that a walk from the root finds."""
    rnd = random.Random(6)

    def path(letters):
        ids = [hashlib.md5("".join(letters[: d + 1]).encode()).digest() for d in range(len(letters))]
        return prefixes._Path(0, prefixes.ROOT, True, b"".join(ids), [1] * len(ids))

    trie, known = prefixes.ZFastTrie(), set()
    for _ in range(600):
        letters = [rnd.choice("ab") for _ in range(rnd.randint(0, 18))]
        node, at = trie.locate(path(letters))
        want = max((d for d in range(len(letters) + 1) if "".join(letters[:d]) in known), default=0)
        assert at == want and node.above <= at <= node.depth
        trie.insert(path(letters), 1, 0, 0)
        known.update("".join(letters[:d]) for d in range(len(letters) + 1))
    assert len(list(trie.expanded())) == len(known | {""})
