"""Permit alerts over a stream of availability changes and of new alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.trips import check_alerts, next_alerts, notifications
from cairn.sources import schemas

SLOTS = "permit_id string, date date, status string, seen_at timestamp"


def latest_slots(changes: DataFrame) -> DataFrame:
    """The last known status per permit and date."""
    return changes.groupBy("permit_id", "date").agg(
        F.max_by("status", "seen_at").alias("status"), F.max("seen_at").alias("seen_at")
    )


def new_alerts_once(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Alert requests without repeats of address, region and start date (created_at is event time)."""
    # a missing date is a value of its own here, and stays missing in the result
    return (
        requests.withColumn("_start", F.coalesce(F.col("start_date").cast("string"), F.lit("")))
        .withWatermark("created_at", late)
        .dropDuplicatesWithinWatermark(["email", "region_id", "_start"])
        .drop("_start")
    )


def _versioned(spark: SparkSession, root: str, name: str, version: int, schema: str) -> DataFrame:
    if version < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}/version={version}")


def watch(
    changes: DataFrame,
    alerts: DataFrame,
    registry: DataFrame,
    root: str,
    clock: Callable[[], Column] = F.current_timestamp,
    asked: DataFrame | None = None,
) -> StreamingQuery:
    """Check alerts after each batch of availability changes until the input is used up.

    ``alerts`` are those known at the start, ``asked`` is a stream of further
    ones with the same columns. One that repeats the address, region and start
    date of a known alert is left out; a missing date equals a missing date.

    State is two tables under ``root``, one version per batch: slots and alerts.
    A batch reads the versions before it and overwrites its own, so a repeated
    batch gives the same result. Whole sorted date sets are compared, so a
    revised slot notifies again and an unchanged set does not.
    """
    spark = changes.sparkSession
    feed = changes.select(F.struct("permit_id", "date", "status", "seen_at").alias("slot"))
    if asked is not None:
        wanted = [f.name for f in T.StructType.fromDDL(schemas.ALERT).fields]
        feed = feed.unionByName(asked.select(F.struct(*wanted).alias("alert")), allowMissingColumns=True)

    def joined(before: DataFrame, batch: DataFrame) -> DataFrame:
        if asked is None:
            return before
        same = ["email", "region_id", "_start"]
        start = F.coalesce(F.col("start_date").cast("string"), F.lit(""))
        fresh = batch.filter("alert is not null").select("alert.*").withColumn("_start", start)
        first = Window.partitionBy(*same).orderBy("created_at", "id")
        fresh = fresh.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
        return before.unionByName(fresh.join(before.withColumn("_start", start), same, "left_anti").drop("_start"))

    def step(batch: DataFrame, number: int) -> None:
        known = _versioned(spark, root, "slots", number - 1, SLOTS)
        slots = latest_slots(known.unionByName(batch.filter("slot is not null").select("slot.*")))
        slots.write.mode("overwrite").parquet(f"{root}/slots/version={number}")
        slots = _versioned(spark, root, "slots", number, SLOTS)
        before = alerts if number == 0 else _versioned(spark, root, "alerts", number - 1, schemas.ALERT)
        checked = check_alerts(joined(before, batch), registry, slots, clock())
        notifications(checked).write.mode("overwrite").parquet(f"{root}/sent/version={number}")
        next_alerts(checked, clock()).write.mode("overwrite").parquet(f"{root}/alerts/version={number}")

    return (
        feed.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
