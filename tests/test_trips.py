"""Documents, sinks, alerts and streams."""

import datetime
import json

from pyspark.sql import functions as F

from cairn.functions import hiking, text, trip
from cairn.operators import itinerary, trips
from cairn.sources import documents, files
from cairn.streaming import alerts as stream_alerts, folds, traffic


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_small_functions(spark):
    assert one(spark, hiking.hiking_time(F.lit(7.0), F.lit(4500))) == "5h 45m"
    assert one(spark, hiking.hiking_time(F.lit(3.999), F.lit(0))) == "2h"
    assert one(spark, text.slug(F.lit("Mt. Foo  Bar!"))) == "mt-foo-bar"
    assert one(spark, text.file_slug(F.lit("A/B c"))) == "a-b-c"
    assert one(spark, trip.weather_text(F.lit(95))) == "Severe thunderstorm"
    assert one(spark, trip.date_list(F.array(*[F.lit(str(i)) for i in range(7)]))) == "0, 1, 2, 3, 4 +2 more"
    assert one(spark, trip.permit_badge(F.lit(True), F.lit(True), F.lit("03-05"), F.lit(False), F.lit(False), F.lit(0))) == "Draw from Mar 5"
    assert len(one(spark, trip.preference_errors(F.lit(0), F.lit(30.0), F.lit("x"), F.lit("soon")))) == 4
    camp = one(spark, hiking.camp(F.lit("Go on. Camp by Blue Lake tonight. End."), F.array(F.lit("Blue Lake")), F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert tuple(camp) == ("by Blue Lake tonight", "Blue Lake", "lake", True)
    assert set(one(spark, text.grams(F.lit("abcä")))) == {"a", "b", "c", "ä", "ab", "bc", "cä", "abc", "bcä"}


def test_reply_forms(spark):
    doc = json.dumps([{"routeName": "A", "archetype": "x", "itinerary": [{"day": 1, "segmentIds": [0], "note": "n"}]}])
    said = [doc, f"```json\n{doc}\n```", "nothing", "not [ json {"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, said string")
    got = {r["i"]: r["r"] for r in df.select("i", documents.reply_array(F.col("said")).alias("r")).collect()}
    assert got[0] == got[1] and got[0][0]["routeName"] == "A" and got[2] is None and got[3] is None


def test_region_files(spark, tmp_path):
    (tmp_path / "north.json").write_text(json.dumps({"name": "North", "bbox": {"minLat": 1.0}, "allowedNonFeatures": ["X"]}))
    (tmp_path / "permit-registry.json").write_text(json.dumps({"regions": {"north": {"permitRequired": True, "permitId": "7"}}}))
    regions = files.read_regions(spark, str(tmp_path)).collect()
    assert [(r["region_id"], r["name"]) for r in regions] == [("north", "North")]
    registry = files.read_registry(spark, str(tmp_path / "permit-registry.json")).first()
    assert (registry["region_id"], registry["permit_id"]) == ("north", "7")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "south.json").write_text(json.dumps({"elements": [{"type": "node", "id": 5, "lat": 1.0, "lon": 2.0}]}))
    row = files.read_elements(spark, str(tmp_path / "x")).first()
    assert (row["region_id"], row["pos"], row["id"]) == ("south", 0, 5)
    assert files.read_alerts(spark, str(tmp_path / "none")).count() == 0


def test_tracks(spark, tmp_path):
    days = spark.createDataFrame(
        [(1, "Loop A!", 0, [(1.5, 2.5), (1.6, 2.6)]), (2, "Empty", 0, None)],
        "request_id long, route_name string, entry int, coords array<struct<lat:double,lon:double>>",
    )
    docs = {r["request_id"]: r for r in itinerary.track_documents(days, ["request_id"]).collect()}
    assert docs[2]["document"] is None and docs[1]["file_name"] == "loop-a-.gpx"
    assert docs[1]["document"].count("<trkpt ") == 2 and '<trkpt lat="1.5" lon="2.5">' in docs[1]["document"]
    files.write_tracks(days, ["request_id"], str(tmp_path / "gpx"))
    assert spark.read.option("wholetext", True).text(str(tmp_path / "gpx")).first()["value"].startswith("<?xml")


def test_normals_window(spark):
    daily = spark.createDataFrame(
        [("p", d, 1.0 + i) for i, d in enumerate(["1990-07-01", "1991-07-01", "1992-01-01", "2020-07-01", "2020-08-01"])], "place_id string, d string, high_f double"
    ).select("place_id", F.to_date("d").alias("date"), "high_f")
    days = spark.createDataFrame([("p", "07-01")], "place_id string, month_day string")
    assert sorted(r["high_f"] for r in trips.calendar_window(daily, days).collect()) == [2.0, 4.0]
    assert sorted(r["high_f"] for r in trips.calendar_window(daily, days, all_days=True).collect()) == [2.0, 3.0, 4.0]


def stream(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode):
    run = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.table(name)


def test_fold_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, None if t % 2 else f"r{t}", "" if t % 3 else f"n{t}", [] if t % 4 else ["lakes", str(t)], t % 5 == 0) for c in range(5) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, region string, notes string, scenery array<string>, ready boolean").repartition(4)
    fields = ["region", "notes", "scenery"]
    batch = {tuple(map(str, r)) for r in folds.fold_preferences(df, fields).collect()}
    drain(folds.fold_preferences(stream(spark, df, str(tmp_path / "chat")), fields), "chat_fold", "complete")
    assert {tuple(map(str, r)) for r in spark.table("chat_fold").collect()} == batch


def test_windows_stream_equals_closed_batch(spark, tmp_path):
    log = spark.range(400).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"),
        F.concat(F.lit("ip"), (F.col("id") % 3).cast("string")).alias("ip"),
    ).repartition(3)
    batch = {tuple(r) for r in traffic.request_counts(log, 10).collect()}
    # files arrive unordered, so the watermark has to cover the whole log
    got = {tuple(r) for r in drain(traffic.request_counts(stream(spark, log.coalesce(1), str(tmp_path / "log")), 10), "counts", "append").collect()}
    assert got and got <= batch
    last = max(r[1] for r in batch)
    assert all((last - r[1]).total_seconds() <= 1200 for r in batch - got)


def test_alert_watch_over_batches(spark, tmp_path):
    alerts = spark.createDataFrame(
        [("a", "x@y.z", "r1", "2024-02-03", None), ("b", "x@y.z", "r2", "2024-02-03", None), ("c", "o@y.z", "r1", "2023-01-01", None)],
        "id string, email string, region_id string, s string, last_notified string",
    ).select("id", "email", "region_id", F.to_date("s").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
             F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_checked"), "last_notified")
    registry = spark.createDataFrame([("r1", "p1", "One", None)], "region_id string, permit_id string, permit_name string, booking_url string")
    changes = [
        [("p1", "2024-02-05", "Available", 1), ("p1", "2024-02-01", "Available", 1)],
        [("p1", "2024-02-05", "Available", 2)],
        [("p1", "2024-02-07", "AVAILABLE", 3)],
        [("p1", "2024-02-05", "Reserved", 4), ("p1", "2024-02-07", "Reserved", 4)],
    ]
    source, root = tmp_path / "changes", str(tmp_path / "state")
    for i, rows in enumerate(changes):
        df = spark.createDataFrame(rows, "permit_id string, d string, status string, s long")
        df.select("permit_id", F.to_date("d").alias("date"), "status", F.timestamp_seconds("s").alias("seen_at")).coalesce(1).write.mode("append").parquet(str(source))
        feed = spark.readStream.schema(stream_alerts.SLOTS).parquet(str(source))
        stream_alerts.watch(feed, alerts, registry, root, lambda: F.lit("2024-01-15").cast("timestamp")).awaitTermination()

    def sent(n):
        return [(r["id"], r["date_list"]) for r in spark.read.parquet(f"{root}/sent/version={n}").collect()]

    assert [sent(n) for n in range(4)] == [[("a", "2024-02-05")], [], [("a", "2024-02-05, 2024-02-07")], []]
    left = {r["id"]: r["last_notified"] for r in spark.read.parquet(f"{root}/alerts/version=3").collect()}
    assert left == {"a": "2024-02-05,2024-02-07", "b": None}


def test_alerts_that_arrive_later(spark, tmp_path):
    """New alerts join the watch; a repeat is left out; one without a start date stays."""
    schema = "id string, email string, region_id string, start_date date, end_date date, created_at timestamp, last_checked timestamp, last_notified string"
    row = lambda i, email, start, at: (i, email, "r1", start, None, datetime.datetime(2024, 1, 1, 0, at), None, None)
    day = datetime.date(2024, 2, 3)
    known = spark.createDataFrame([row("a", "x@y.z", day, 0)], schema)
    registry = spark.createDataFrame([("r1", "p1", "One", None)], "region_id string, permit_id string, permit_name string, booking_url string")
    slots, asked, root = tmp_path / "slots", tmp_path / "asked", str(tmp_path / "state")
    later = [[], [row("b", "n@y.z", day, 1), row("c", "x@y.z", day, 2), row("d", "n@y.z", day, 3), row("e", "z@y.z", None, 4)]]
    for i, rows in enumerate(later):
        df = spark.createDataFrame([("p1", datetime.date(2024, 2, 5), "Available", datetime.datetime(2024, 1, 2, 0, i))], stream_alerts.SLOTS)
        df.coalesce(1).write.mode("append").parquet(str(slots))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(asked))
        stream_alerts.watch(
            spark.readStream.schema(stream_alerts.SLOTS).parquet(str(slots)), known, registry, root,
            lambda: F.lit("2024-01-15").cast("timestamp"), spark.readStream.schema(schema).parquet(str(asked)),
        ).awaitTermination()
    sent = [{r["id"] for r in spark.read.parquet(f"{root}/sent/version={n}").collect()} for n in range(2)]
    assert sent == [{"a"}, {"b"}]
    left = {r["id"]: r["start_date"] for r in spark.read.parquet(f"{root}/alerts/version=1").collect()}
    assert left == {"a": day, "b": day, "e": None}
