"""The trie of common beginnings of conversations, by Z-fast tries.

A node stands for a sequence of turns; its key is a sum modulo a prime of 127 bits
over the turns' digests, each times a power of a fixed base, so equal sequences
have equal keys and sums over parts of a conversation add up. A task keeps the
paths it meets in a trie of compacted edges. Every edge is found under the key of
its path at its two-fattest depth; the place where a new path leaves the trie is
found by a search over those depths, in steps that halve. Paths enter in batches,
equal ones once. When a trie grows past a bound its edges are expanded to nodes and
summed up over all tasks by key; so a beginning that a third of all conversations
share leaves each task as one row.

Sums over subtrees need no walk: a node belongs to the least of its members, and
what a member owns is added to every node on its path.

Turns without an id of a conversation belong to none. Null roles and texts are
empty, null turns come first, and turns of equal number go by their digest; equal
rows are so many turns. An id ``c`` belongs to the group ``c - c % 100`` with the
sign of ``c``. Conversations of any length are cut into parts of ``PART`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.llm.common import partitions, slices
from cairn.session import Stages

HEAD = 5  # turns at most that a conversation takes over
PART = 4096  # turns of one row
TRIE_TURNS = 200_000  # turns of a trie, one part more at most
ENDS = 1 << 16  # ids of conversations in one row
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D2B79F1A3C6EF372FE94F82B
ROOT = bytes(16)

_ROWS = "conv_id long, part int, start long, digests binary, chars array<int>, prior binary, total binary, last boolean"
_PATHS = "conv_id long, base long, base_id binary, starts boolean, ids binary, chars array<int>, ends boolean"
_NODES = "id binary, parent binary, depth long, chars long, first long, second long, least long"


def _key(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _value(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _turn(digest: bytes) -> int:
    return int.from_bytes(digest, "big") % (PRIME - 1) + 1


def _digest() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _rows(turns: DataFrame, part_turns: int) -> DataFrame:
    """Parts of conversations in the order of their turns, counted from where each task meets them.

    ``prior`` and ``total`` are sums over the turns of a conversation that the task met before and after the part.
    """
    cells = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _digest().alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
    ).filter("conv_id is not null")
    keys = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")]
    cells = cells.repartitionByRange(partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, start, digests, chars, total, power = None, 1, [], [], 0, 1
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal start, digests, chars, total, power
            if digests:
                prior = _key(total)
                for d in digests:
                    power = power * BASE % PRIME
                    total = (total + _turn(d) * power) % PRIME
                out.append((conv, part, start, b"".join(digests), chars, prior, _key(total), last))
                start += len(digests)
                digests, chars = [], []

        for batch in slices(batches):
            for c, d, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if c != conv:
                    close(False)
                    conv, start, total, power = c, 1, 0, 1
                elif len(digests) >= part_turns:
                    close(False)
                digests.append(d)
                chars.append(n)
            yield _batch(out, _ROWS)
            out = []
        close(True)
        yield _batch(out, _ROWS)

    return cells.mapInArrow(run, _ROWS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    columns = list(zip(*rows)) or [()] * len(schema.split(", "))
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[c.split()[1]]) for c, v in zip(schema.split(", "), columns)], names)


def _carried(rows: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For every task that goes on with a conversation: its id, its turns and their sum before that task.

    Holds one row a task at most.
    """
    edges = rows.groupBy("part").agg(
        F.min("conv_id").alias("first"),
        F.max(F.when(F.col("last"), F.struct("conv_id", (F.col("start") + F.size("chars") - 1).alias("turns"), "total"))).alias("last"),
    )
    carried: dict[int, tuple[int, int, int]] = {}
    open_conv, turns, total = None, 0, 0
    for e in sorted(edges.collect(), key=lambda e: e.part):
        if e.first == open_conv:
            carried[e.part] = (open_conv, turns, total)
        else:
            turns, total = 0, 0
        if e.last.conv_id != e.first:
            turns, total = 0, 0
        total = (total + _value(e.last.total) * pow(BASE, turns, PRIME)) % PRIME
        turns += e.last.turns
        open_conv = e.last.conv_id
    return carried


def _taken(conv_id: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)


def rebuilt(turns: DataFrame, stages: Stages, part_turns: int = PART) -> DataFrame:
    """Paths of the rebuilt conversations, a row for every part: the keys and code points of its turns."""
    spark = turns.sparkSession
    rows = stages.cut(_rows(turns, part_turns))
    carried = _carried(rows)
    shift = spark.createDataFrame([(p, c, n, _key(t)) for p, (c, n, t) in carried.items()], "part int, conv_id long, before long, carry binary")
    rows = rows.join(F.broadcast(shift), ["part", "conv_id"], "left").fillna(0, ["before"])
    rows = rows.withColumn("start", F.col("start") + F.col("before"))
    # the first turns of every conversation, and how many it has
    in_head = F.col("start") <= HEAD
    heads = rows.groupBy("conv_id").agg(
        F.sum(F.size("chars")).alias("turns"),
        F.array_sort(
            F.collect_list(F.when(in_head, F.struct("start", F.substring("digests", 1, 16 * HEAD).alias("digests"), F.slice("chars", 1, HEAD).alias("chars"))))
        ).alias("head"),
    )
    heads = heads.select(
        "conv_id",
        "turns",
        F.slice(F.flatten("head.chars"), 1, HEAD).alias("head_chars"),
        F.substring(F.aggregate("head.digests", F.lit(b""), lambda a, b: F.concat(a, b)), 1, 16 * HEAD).alias("head"),
    )
    groups = heads.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("group"), F.col("head").alias("given"), F.col("head_chars").alias("given_chars"))
    known = heads.withColumn("group", F.expr("conv_id - conv_id % 100")).join(groups, "group", "left").drop("head_chars")
    parts = rows.join(known, "conv_id").select(
        "conv_id", "start", "digests", "chars", "prior", "before", "carry", "turns", "head", "given", "given_chars", _taken(F.col("conv_id")).cast("int").alias("taken")
    )
    return stages.cut(parts.mapInArrow(_paths, _PATHS))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        yield _batch([_path(**r) for r in batch.to_pylist()], _PATHS)


def _sums(digests: list[bytes], total: int, power: int) -> tuple[list[int], int]:
    """Running sums over turns, and the power of the last one."""
    out = []
    for d in digests:
        power = power * BASE % PRIME
        total = (total + _turn(d) * power) % PRIME
        out.append(total)
    return out, power


def _cells(data: bytes | None) -> list[bytes]:
    return [data[i : i + 16] for i in range(0, len(data or b""), 16)]


def _path(conv_id, start, digests, chars, prior, before, carry, turns, head, given, given_chars, taken) -> tuple:
    """One part of a conversation with its first ``taken`` turns exchanged."""
    given = _cells(given)[:taken]
    over = len(given)
    given_sums, power = _sums(given, 0, 1)
    front = given_sums[-1] if given else 0
    cells = _cells(digests)
    ends = start + len(cells) - 1 == turns
    skip = min(max(taken - start + 1, 0), len(cells))
    if start <= taken + 1:  # its own turns follow the ones taken over
        base, base_sum = over, front
        sums, _ = _sums(cells[skip:], front, power)
    else:  # the sum before this part, less its own first turns, behind the ones taken over
        own, _ = _sums(_cells(head)[:taken], 0, 1)
        moved = pow(BASE, over - taken, PRIME)
        base = over + start - 1 - taken
        passed = _value(carry or ROOT) + pow(BASE, before, PRIME) * _value(prior)
        base_sum = (front + moved * (passed - (own[-1] if own else 0))) % PRIME
        sums, _ = _sums(cells, base_sum, pow(BASE, base, PRIME))
    chars = chars[skip:]
    if start == 1:
        sums, chars, base, base_sum = given_sums + sums, (given_chars or [])[:taken] + chars, 0, 0
    return conv_id, base, _key(base_sum), start == 1, b"".join(map(_key, sums)), chars, ends


class _Node:
    """An edge of the compacted trie: depths over ``above`` up to ``depth`` of one path."""

    __slots__ = ("above", "depth", "path", "parent", "children", "first", "second", "least")

    def __init__(self, above: int, depth: int, path: "_Path | None", parent: "_Node | None"):
        self.above, self.depth, self.path, self.parent = above, depth, path, parent
        self.children: dict[bytes, _Node] = {}
        self.first = self.second = 0
        self.least: int | None = None

    def add(self, first: int, second: int, least: int) -> None:
        self.first += first
        self.second += second
        self.least = least if self.least is None else min(self.least, least)


class _Path:
    """Keys of a path below its base; ``self[d]`` is the key at depth ``d``.

    ``starts`` tells that it is the first part of a conversation, which the root counts.
    """

    __slots__ = ("base", "base_id", "starts", "ids", "chars", "depth")

    def __init__(self, base: int, base_id: bytes, starts: bool, ids: bytes, chars: list[int]):
        self.base, self.base_id, self.starts, self.ids, self.chars = base, base_id, starts, ids, chars
        self.depth = base + len(ids) // 16

    def __getitem__(self, depth: int) -> bytes:
        at = 16 * (depth - self.base)
        return self.ids[at - 16 : at] if at else self.base_id


def two_fattest(low: int, high: int) -> int:
    """The number over ``low`` and up to ``high`` that the greatest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class _Tree:
    """A root and the handles of all edges below it."""

    __slots__ = ("root", "handles")

    def __init__(self, path: _Path):
        self.root = _Node(path.base, path.base, path, None)
        self.handles: dict[bytes, _Node] = {}

    def hang(self, node: _Node) -> None:
        self.handles[node.path[two_fattest(node.above, node.depth)]] = node
        node.parent.children[node.path[node.above + 1]] = node


class ZFastTrie:
    """Paths in compacted edges, each found under the key at its two-fattest depth.

    Parts of conversations hang below the key they go on from, a tree for each.
    """

    def __init__(self):
        self.trees: dict[tuple[bytes, bool], _Tree] = {}
        self.turns = 0

    def _tree(self, path: _Path) -> _Tree:
        key = (path.base_id, path.starts)
        if key not in self.trees:
            self.trees[key] = _Tree(path)
        return self.trees[key]

    def locate(self, path: _Path) -> tuple[_Node, int]:
        """The deepest edge that the path enters, and the depth at which it leaves it."""
        tree = self._tree(path)
        node, low, high = tree.root, path.base, path.depth
        while low < high:
            at = two_fattest(low, high)
            found = tree.handles.get(path[at])
            if found is None:
                high = at - 1
            elif found.depth <= path.depth and found.path[found.depth] == path[found.depth]:
                node, low = found, found.depth
            else:
                node = found
                break
        else:
            if low < path.depth:  # the edge below may agree for less than its two-fattest depth
                node = node.children.get(path[low + 1], node)
        # keys are of whole beginnings, so the last equal one is found by halving
        low, high = max(node.above, path.base), min(node.depth, path.depth)
        while low < high:
            middle = (low + high + 1) // 2
            if node.path[middle] == path[middle]:
                low = middle
            else:
                high = middle - 1
        return node, low

    def insert(self, path: _Path, first: int, second: int, least: int) -> None:
        node, at = self.locate(path)
        tree = self._tree(path)
        if at < node.depth:  # the edge is cut in two
            upper = _Node(node.above, at, node.path, node.parent)
            del tree.handles[node.path[two_fattest(node.above, node.depth)]]
            tree.hang(upper)
            node.above, node.parent = at, upper
            tree.hang(node)
            node = upper
        if at < path.depth:
            below = _Node(at, path.depth, path, node)
            tree.hang(below)
            self.turns += path.depth - at
            node = below
        node.add(first, second, least)

    def nodes(self) -> Iterator[_Node]:
        """All edges, each before the one above it, with the sums over what hangs below."""
        out, todo = [], [t.root for t in self.trees.values()]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(node.children.values())
        for node in reversed(out):
            if node.parent is not None and node.least is not None:
                node.parent.add(node.first, node.second, node.least)
            yield node

    def expanded(self) -> Iterator[tuple]:
        """A row for every depth of every edge: key, key above, depth, code points, sums, least id."""
        for node in self.nodes():
            path, sums = node.path, (node.first, node.second, node.least)
            if node.parent is None and path.starts:
                yield (ROOT, None, 0, 0, *sums)
            for d in range(node.above + 1, node.depth + 1):
                yield (path[d], path[d - 1], d, path.chars[d - path.base - 1], *sums)


def tried(paths: DataFrame, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """Rows of nodes from ``conv_id, base, base_id, starts, ids, chars, first, second``, summed up per trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in slices(batches):
            equal: dict[tuple[bytes, bool, bytes], list] = {}
            for conv, base, base_id, starts, ids, chars, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                known = equal.setdefault((base_id, starts, ids), [_Path(base, base_id, starts, ids, chars), 0, 0, conv])
                known[1] += first
                known[2] += second
                known[3] = min(known[3], conv)
            for path, first, second, least in equal.values():
                trie.insert(path, first, second, least)
                if trie.turns >= trie_turns:
                    yield from _emitted(trie)
                    trie = ZFastTrie()
        yield from _emitted(trie)

    return paths.select("conv_id", "base", "base_id", "starts", "ids", "chars", "first", "second").mapInArrow(run, _NODES)


def _emitted(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in trie.expanded():
        rows.append(row)
        if len(rows) >= 8192:
            yield _batch(rows, _NODES)
            rows = []
    yield _batch(rows, _NODES)


def _end_hashes(paths: DataFrame) -> DataFrame:
    """``id, ends_sha256`` of the nodes where conversations end.

    Ids are joined in rows of ``ENDS`` ids at most; the hash runs over these rows in order.
    """
    last = F.when(F.length("ids") > 0, F.expr("substring(ids, length(ids) - 15, 16)")).otherwise(F.col("base_id"))
    ends = paths.filter("ends").select(last.alias("id"), "conv_id")
    texts = ends.groupBy("id", F.floor(F.col("conv_id") / ENDS).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in slices(batches, 64):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"id": [k for k, _ in out], "ends_sha256": [h for _, h in out]})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"id": [node], "ends_sha256": [state.hexdigest()]})

    return texts.repartition("id").sortWithinPartitions("id", "block").mapInArrow(run, "id binary, ends_sha256 string")


def trie(turns: DataFrame, part_turns: int = PART, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its members, leaves and saved code points."""
    stages = Stages(turns.sparkSession)
    paths = rebuilt(turns, stages, part_turns)
    nodes = stages.cut(
        tried(paths.withColumns({"first": F.lit(1).cast("long"), "second": F.lit(0).cast("long")}), trie_turns)
        .groupBy("id")
        .agg(
            F.first("parent").alias("parent"),
            F.first("depth").alias("depth"),
            F.first("chars").alias("chars"),
            F.sum("first").alias("n_convs"),
            F.min("least").alias("conv_id"),
        )
    )
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    nodes = stages.cut(
        nodes.join(children, "id", "left").fillna(0, ["n_children"]).withColumns({"saved": saved, "block": F.floor(F.col("depth") / part_turns)})
    )
    # what a member owns, and of that what lies above each of its nodes
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("first"), F.count_if(F.col("n_children") == 0).alias("second"))
    sums = (
        tried(paths.join(owned.filter("first > 0 or second > 0"), "conv_id"), trie_turns)
        .groupBy("id")
        .agg(F.sum("first").alias("all_saved"), F.sum("second").alias("n_leaves"))
    )
    above = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    blocks_above = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"))
    blocks = blocks.select("conv_id", "block", F.sum("saved").over(blocks_above).alias("earlier")).filter("block > 0 and earlier > 0")
    placed = nodes.withColumn("higher", F.coalesce(F.sum("saved").over(above), F.lit(0))).join(blocks, ["conv_id", "block"], "left")
    owners = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (
        placed.join(sums, "id", "left")
        .join(_end_hashes(paths), "id", "left")
        .join(owners, "parent", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
            (F.coalesce("all_saved", F.lit(0)) - F.col("higher") - F.coalesce("earlier", F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )


#: crc32 of a text of ASCII characters, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}, ''),
    lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295::bigint)"""

SQL = f"""
with recursive turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as j
  from conversations where conv_id is not null),
convs as (select conv_id, {_CRC.format('conv_id::varchar')} % 6 as h from (select distinct conv_id from turns)),
kept as (
  select c.conv_id, t.j, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.j <= c.h
  union all
  select c.conv_id, t.j + 10, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.j > c.h),
steps as (select *, row_number() over (partition by conv_id order by j) as depth from kept),
paths as (
  select conv_id, 0::bigint as depth, '' as id, null::varchar as parent, '' as text from convs
  union all
  select p.conv_id, s.depth, md5(p.id || strlen(s.role) || ':' || s.role || s.text), p.id, s.text
  from paths p join steps s on s.conv_id = p.conv_id and s.depth = p.depth + 1),
lengths as (select conv_id, max(depth) as n from paths group by conv_id),
nodes as (
  select id, depth, any_value(parent) as parent, any_value(length(text)) as chars, count(*) as n_convs, min(conv_id) as conv_id
  from paths group by id, depth),
children as (select parent as id, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all),
below as (
  select id as top, depth as top_depth, id, depth from nodes
  union all
  select b.top, b.top_depth, n.id, n.depth from below b join nodes n on n.parent = b.id and n.depth = b.depth + 1),
totals as (
  select top as id, top_depth as depth, sum((n_convs - 1) * chars)::bigint as saved_tokens,
    count(*) filter (where n_children is null) as n_leaves
  from below join nodes using (id, depth) left join children using (id, depth) group by all),
ends as (
  select id, p.depth, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256
  from paths p join lengths l using (conv_id) where p.depth = l.n group by all)
select n.conv_id, n.depth, o.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
  saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from nodes n join totals using (id, depth) left join children using (id, depth) left join ends using (id, depth)
left join nodes o on o.id = n.parent and o.depth = n.depth - 1
"""
