"""Streams with keyed state and timers next to tables and to a walk batch by batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cairn.streaming import watched as w, windows

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def brute_windows(rows):
    out, by_key = [], {}
    for kind, key, width, ts, value in rows:
        by_key.setdefault((kind, key, width), []).append((ts, value))
    for (kind, key, width), own in by_key.items():
        start = None
        for ts, value in sorted(own, key=lambda x: (x[0], x[1] or "")):
            if start is None or (ts - start).total_seconds() >= width:
                if start is not None:
                    out.append((kind, key, start, n, last))
                start, n, last = ts, 0, None
            n, last = n + 1, value if value is not None else last
        out.append((kind, key, start, n, last))
    return sorted(out, key=str)


SCHEMA = "kind string, key string, width long, ts timestamp, value string"


def made(count, seed):
    rnd = random.Random(seed)
    return [("api", rnd.choice(["a", "b", "hot", "hot", "hot", None]), 600, at(rnd.randint(0, 900) / 4), rnd.choice(["x", "y"])) for _ in range(count)]


def test_windows_of_a_table(spark):
    rows = made(400, 1) + [("other", "a", 3600, at(m), "z") for m in (0, 59, 60, 61, 500)]
    table = spark.createDataFrame(rows + [("api", "a", 600, None, "no time")], SCHEMA)
    got = [(r.kind, r.key, r.start, r.rows, r["last"]) for r in windows.first_windows(table).collect()]
    assert sorted(got, key=str) == brute_windows(rows)
    assert windows.first_windows(table.limit(0)).count() == 0


def test_stream_of_windows_equals_the_table(spark, rocks, tmp_path):
    """Rows out of order across batches, and windows that end while no row comes."""
    rows = [r for r in made(150, 2) if r[1] is not None]
    rows.sort(key=lambda r: r[3] + datetime.timedelta(minutes=random.Random(str(r)).uniform(0, 9)))
    flush = [("api", "end", 600, at(3000), "f"), ("api", "end", 600, at(4000), "f")]
    batches = [rows[:60], rows[60:110], rows[110:], flush[:1], flush[1:]]
    source = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    query = windows.streamed_windows(feed).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r.kind, r.key, r.start, r.rows, r["last"]) for r in spark.read.parquet(out).collect() if r.key != "end"), key=str)
    want = [(r.kind, r.key, r.start, r.rows, r["last"]) for r in windows.first_windows(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == sorted(want, key=str) == brute_windows(rows)


REGISTRY = [("r1", "p1", "One", "https://example.org/1"), ("r2", "p2", "Two", None), ("r3", None, "None", None)]
ALERT = "id string, email string, region_id string, start_date date, end_date date, created_at timestamp"


def day(n):
    return datetime.date(2024, 1, n)


def test_alerts_with_keyed_state(spark, rocks, tmp_path):
    """Late alerts, repeated alerts, revised and old slots, another month, an alert that runs out."""
    slots = [
        [("p1", day(20), "Available", at(0)), ("p1", day(22), "Full", at(0)), ("p2", day(25), "AVAILABLE", at(1))],
        [("p1", day(20), "Available", at(60)), ("p1", day(22), "Available", at(60)), ("p1", datetime.date(2024, 2, 1), "Available", at(61))],
        [("p1", day(22), "Full", at(30)), ("p2", day(25), "Full", at(120))],
        [("p2", day(26), "Available", at(60 * 24 * 14))],
        [("p1", day(23), "Available", at(60 * 24 * 19))],
    ]
    alerts = [
        [("1", "u@example.org", "r1", day(15), None, at(0)), ("2", "u@example.org", "r2", day(25), None, at(0)), ("3", "u@example.org", "r3", day(1), None, at(0))],
        [("4", "u@example.org", "r1", day(15), None, at(60)), ("5", "v@example.org", "r1", day(21), None, at(60)), ("6", "w@example.org", "r1", None, None, at(60))],
        [("7", "x@example.org", "r1", day(22), None, at(120))],
        [],
        [("8", "y@example.org", "r1", day(2), None, at(60 * 24 * 19))],
    ]
    for i, (s, a) in enumerate(zip(slots, alerts)):
        spark.createDataFrame(s, "permit_id string, date date, status string, seen_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "slots"))
        spark.createDataFrame(a, ALERT).coalesce(1).write.mode("append").parquet(str(tmp_path / "alerts"))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    registry = spark.createDataFrame(REGISTRY, "region_id string, permit_id string, permit_name string, booking_url string")
    sent = w.watched(stream("slots", "permit_id string, date date, status string, seen_at timestamp"), stream("alerts", ALERT), registry)
    out = str(tmp_path / "out")
    query = sent.withColumn("batch", F.current_timestamp()).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    got = sorted((r.id, r.outcome, ",".join(r.dates or [])) for r in rows.collect())
    assert got == sorted(
        [
            ("1", "notify", "2024-01-20"),
            ("1", "notify", "2024-01-20,2024-01-22"),
            ("1", "notify", "2024-01-20,2024-01-22,2024-01-23"),  # the clock of this batch is its first day
            ("1", "expired", ""),
            ("2", "notify", "2024-01-25"),
            ("2", "notify", "2024-01-26"),
            ("5", "notify", "2024-01-22"),
            ("5", "notify", "2024-01-22,2024-01-23"),
            ("7", "notify", "2024-01-22"),
            ("7", "notify", "2024-01-22,2024-01-23"),
        ]
    )
    told = {(r.id, r.subject, r.booking_url) for r in w.messages(rows).collect()}
    assert ("1", "Open dates: One", "https://example.org/1") in told and ("2", "Open dates: Two", "https://www.recreation.gov") in told
