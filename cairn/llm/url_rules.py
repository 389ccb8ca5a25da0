"""Allow and block rules for urls by a sort-merge range join.

A host is turned into a key of its labels from the last to the first, so that
the hosts under a rule are one interval of keys. Urls and rules are dealt out
by ranges of (key, page_id); a rule goes to every range that its interval
touches. In each range one sweep in key order keeps a stack of the rules whose
intervals are open: they are nested, as the key of each begins with the one
below. Among the open rules whose path begins the url's path the longest rule
wins.

Nulls: a url that is null or has no ``://`` has an empty host and path, which no
rule fits but one with an empty host. Rules of equal length: the longer host
wins, then block. Repeated rules count once. Repeated rows give repeated rows.
Without rules every url gets the default. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm.common import lower_ascii, partitions

PER_RANGE = 50  # sampled places that set one bound
LAST = "\U0010ffff"
FIRST_ID, LAST_ID = -(1 << 63), (1 << 63) - 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def host_key(host: Column) -> Column:
    """``blog.example.com`` becomes ``com.example.blog.``; an empty host stays empty."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of pages. ``rules``: host, path, action."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    n = partitions(pages.sparkSession)
    place = F.struct("key", F.coalesce("page_id", F.lit(FIRST_ID)).alias("page_id"))
    # any sample gives right results; an even one gives even ranges
    some = urls.select(place.alias("p")).orderBy(F.xxhash64("p"), "p").limit(PER_RANGE * n).collect()
    bounds = sorted({(r.p.key, r.p.page_id) for r in some})[PER_RANGE::PER_RANGE]

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("page_id").to_pylist()
            parts = [bisect_right(bounds, (k, FIRST_ID if i is None else i)) for k, i in zip(keys, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            copies = [
                {"part": p, **r}
                for r in rows
                for p in range(bisect_left(bounds, (r["key"], FIRST_ID)), bisect_right(bounds, (r["key"] + LAST, LAST_ID)) + 1)
            ]
            yield pa.RecordBatch.from_pylist(copies, pa.schema([("part", pa.int32()), *batch.schema]))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[int, int, bool, str, str, str]]]] = []
        now = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "kind", "page_id", "host", "path", "action")]
            out: list[tuple] = []
            for part, key, kind, page_id, host, path, action in zip(*columns):
                if part != now:
                    stack, now = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    rule = (len(host) + len(path), len(host), action == "block", host, path, action)
                    if stack and stack[-1][0] == key:
                        stack[-1][1].append(rule)
                    else:
                        stack.append((key, [rule]))
                    continue
                best = max((r for _, open_ in stack for r in open_ if path.startswith(r[4])), default=None)
                out.append((page_id, host, path, best and best[3] + best[4], best[5] if best else default))
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["page_id", "host", "path", "rule", "verdict"]
            )

    fields = "kind int, key string, page_id long, host string, path string, action string"
    names = [f.split()[0] for f in fields.split(", ")]
    as_urls = urls.select(F.lit(1).alias("kind"), "key", "page_id", "host", "path", F.lit(None).cast("string").alias("action"))
    as_rules = (
        rules.select(F.coalesce(lower_ascii(F.col("host")), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .distinct()
        .select(F.lit(0).alias("kind"), host_key(F.col("host")).alias("key"), F.lit(None).cast("long").alias("page_id"), "host", "path", "action")
    )
    both = as_urls.select(*names).mapInArrow(place_urls, f"part int, {fields}").unionByName(
        as_rules.select(*names).mapInArrow(place_rules, f"part int, {fields}")
    )
    return (
        both.repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("part", "key", "kind", F.col("page_id").asc_nulls_first())
        .mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
    )


#: host, path, action of the registered query
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_HOST = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with r(h, p, a) as (values {", ".join(map(str, RULES))}),
u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
v as (select page_id, {_HOST} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
m as (select page_id, host, path, h || p rule, a,
  row_number() over (partition by page_id, host, path order by len(h || p) desc) k
  from v left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(a, 'allow') verdict from m where k = 1
"""
