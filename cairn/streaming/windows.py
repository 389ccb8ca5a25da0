"""Windows that open with the first row of a key, as tables and as keyed state with timers.

A window lasts a given number of seconds from the row that opens it; the first
row at or after its end opens the next one. Request limits of an address and the
life of a job work that way; windows on the clock cannot express it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cairn.session import Stages
from cairn.streaming.traffic import LIMITS

WINDOW = "kind string, key string, start timestamp, rows long, last string"


def keyed_requests(log: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Every request once for each limit: ``kind, key, width, ts, value``."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m * 60).cast("long").alias("width")) for k, (m, _) in limits.items()])
    return log.select(F.explode(kinds).alias("k"), "ip", "ts").select("k.kind", F.col("ip").alias("key"), "k.width", "ts", F.lit(None).cast("string").alias("value"))


def keyed_jobs(updates: DataFrame, minutes: int = 60) -> DataFrame:
    """Updates ``job_id, ts, status`` as rows of windows."""
    return updates.select(F.lit("job").alias("kind"), F.col("job_id").alias("key"), F.lit(minutes * 60).cast("long").alias("width"), "ts", F.col("status").alias("value"))


def over_limit(windows: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Windows with whether they pass the limit of their kind."""
    most = F.create_map(*[F.lit(x) for k, (_, n) in limits.items() for x in (k, n)])
    return windows.select("kind", "start", F.col("key").alias("ip"), F.col("rows").alias("requests"), (F.col("rows") > most[F.col("kind")]).alias("over"))


def first_windows(rows: DataFrame) -> DataFrame:
    """``kind, key, start, rows, last`` of a table of ``kind, key, width, ts, value``.

    ``last`` is the value of the latest row, the greatest of equal times. Rows
    without a time are left out; a null key is a key. Every time gets the first
    time at or after the end of a window that would open there, found by one
    ordered pass; from the first time of a key, jumps along these that double
    every round reach all openings. A key's rows are dealt out by stretches of a
    window's width, so a hot key is spread over the span of its times.
    """
    stages = Stages(rows.sparkSession)
    key = ["kind", "key"]
    at = F.unix_micros("ts")
    times = stages.cut(
        rows.filter("ts is not null")
        .withColumns({"key": F.struct("key"), "at": at, "stretch": F.floor(at / (F.col("width") * 1_000_000))})
        .groupBy(*key, "width", "stretch", "at")
        .agg(F.count("*").alias("rows"), F.max("value").alias("last"))
    )
    ends = times.select(*key, "width", (F.col("at") + F.col("width") * 1_000_000).alias("at"), F.col("at").alias("opened"))
    ends = ends.withColumn("stretch", F.floor(F.col("at") / (F.col("width") * 1_000_000)))
    both = times.select(*key, "stretch", "at", F.lit(None).cast("long").alias("opened")).unionByName(ends.drop("width"))
    real = F.when(F.col("opened").isNull(), F.col("at"))
    behind = Window.partitionBy(*key, "stretch").orderBy(F.desc("at"), F.asc_nulls_first("opened")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*key).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = both.groupBy(*key, "stretch").agg(F.min(real).alias("first")).withColumn("later", F.min("first").over(later)).drop("first")
    jumps = (
        both.withColumn("next", F.min(real).over(behind))
        .filter("opened is not null")
        .join(stretches, [*key, "stretch"])
        .select(*key, F.col("opened").alias("at"), F.coalesce("next", "later").alias("next"))
        .filter("next is not null")
    )
    jumps = stages.cut(jumps)
    opened = stages.cut(times.groupBy(*key).agg(F.min("at").alias("at")))
    while True:
        reached = opened.join(jumps, [*key, "at"]).select(*key, F.col("next").alias("at"))
        opened = stages.cut(opened.withColumn("old", F.lit(1)).unionByName(reached.withColumn("old", F.lit(0))).groupBy(*key, "at").agg(F.max("old").alias("old")), "old = 0")
        opened = opened.drop("old")
        if not stages.seen["old = 0"]:
            break
        after = jumps.select(*key, F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = stages.cut(jumps.join(after, [*key, "next"]).select(*key, "at", F.col("then").alias("next")))
    # every time belongs to the latest opening before it
    marked = times.join(opened.withColumn("opens", F.col("at")), [*key, "at"], "left")
    within = Window.partitionBy(*key, "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*key, "stretch").agg(F.max("opens").alias("latest")).withColumn("before", F.max("latest").over(before)).drop("latest")
    return (
        marked.withColumn("own", F.max("opens").over(within))
        .join(carried, [*key, "stretch"])
        .groupBy(*key, F.coalesce("own", "before").alias("start"))
        .agg(F.sum("rows").alias("rows"), F.max_by("last", "at").alias("last"))
        .select("kind", "key.key", F.timestamp_micros("start").alias("start"), "rows", "last")
    )


class _Windows(StatefulProcessor):
    """Rows wait until the watermark has passed their minute, then they enter windows in order of time."""

    TICK = 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows long, last string")
        self.open = handle.getValueState("open", "start long, width long, rows long, last string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ticks = set()
        for part in rows:
            # a datetime64 column counts in its own unit
            at = part["ts"].astype("datetime64[us]").astype("int64")
            for t, value, width in zip(at.tolist(), part["value"].tolist(), part["width"].tolist()):
                value = value if isinstance(value, str) else None
                n, last = self.waiting.getValue((t,)) if self.waiting.containsKey((t,)) else (0, None)
                self.waiting.updateValue((t,), (n + 1, max((v for v in (value, last) if v is not None), default=None)))
                ticks.add((t // 1000 // self.TICK + 1) * self.TICK)
                self.width = int(width)
        if not self.open.exists():
            self.open.update((-1, self.width, 0, None))
        for tick in ticks:
            self.handle.registerTimer(tick)
        yield self._closed(key, [])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        start, width, n, last = self.open.get()
        closed = []
        for t, (rows, value) in sorted((k[0], v) for k, v in self.waiting.iterator() if k[0] < now):
            self.waiting.removeKey((t,))
            if start >= 0 and t >= start + width * 1_000_000:
                closed.append((start, n, last))
                start = -1
            if start < 0:
                start, n, last = t, 0, None
                self.handle.registerTimer((t // 1000 + width * 1000) // self.TICK * self.TICK + 2 * self.TICK)
            n, last = n + rows, value if value is not None else last
        if start >= 0 and now >= start + width * 1_000_000:
            closed.append((start, n, last))
            start, n, last = -1, 0, None
        if start < 0 and not any(True for _ in self.waiting.keys()):
            self.open.clear()  # nothing is kept of a key without rows
        else:
            self.open.update((start, width, n, last))
        yield self._closed(key, closed)

    @staticmethod
    def _closed(key, closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "kind": pd.Series([key[0]] * len(closed), dtype="object"),
                "key": pd.Series([key[1]] * len(closed), dtype="object"),
                "start": pd.Series([s for s, _, _ in closed], dtype="int64").astype("datetime64[us]"),
                "rows": pd.Series([n for _, n, _ in closed], dtype="int64"),
                "last": pd.Series([v for _, _, v in closed], dtype="object"),
            }
        )

    def close(self) -> None:
        pass


def streamed_windows(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``first_windows`` of a stream; a window is given out once the watermark has passed its end.

    Rows may come in any order within ``late``. State per key: the open window,
    and the rows that the watermark has not passed yet, one entry per time. Needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return (
        rows.filter("ts is not null")
        .withWatermark("ts", late)
        .groupBy("kind", "key")
        .transformWithStateInPandas(_Windows(), outputStructType=WINDOW, outputMode="append", timeMode="eventTime")
    )
