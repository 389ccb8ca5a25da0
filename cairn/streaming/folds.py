"""Latest-value folds: conversation preferences and job states.

Both are plain aggregates, so one definition serves a table and a stream (in
update mode the state per key is the aggregate's buffer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREF_FIELDS = [
    "region",
    "location",
    "startDate",
    "endDate",
    "daysTarget",
    "milesPerDayTarget",
    "elevationTolerance",
    "sceneryPreferences",
    "crowdPreference",
    "experienceLevel",
    "groupType",
    "avoid",
    "priorities",
    "notes",
]


def fold_preferences(blocks: DataFrame, fields: list[str], keys: list[str] = ["conv_id"]) -> DataFrame:  # noqa: B006
    """Per conversation, the latest filled value of each field, and ``ready`` of the latest block.

    ``blocks``: keys, turn, ready and the fields as strings or string arrays.
    Null, empty text and empty arrays never overwrite.
    """
    types = dict(blocks.dtypes)

    def filled(name: str) -> Column:
        c = F.col(name)
        empty = F.size(c) == 0 if types[name].startswith("array") else c.cast("string") == ""
        return c.isNotNull() & ~empty

    return blocks.groupBy(*keys).agg(
        *[F.max_by(F.col(f), F.when(filled(f), F.col("turn"))).alias(f) for f in fields],
        F.max_by(F.coalesce("ready", F.lit(False)), "turn").alias("ready"),
    )


def latest_jobs(updates: DataFrame) -> DataFrame:
    """Last state per job. ``updates``: job_id, ts, status."""
    return updates.groupBy("job_id").agg(
        F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("updates")
    )


def live_jobs(updates: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Jobs whose first update is not older than ``minutes`` at ``now``."""
    first = updates.groupBy("job_id").agg(
        F.max_by("status", "ts").alias("status"), F.min("ts").alias("created_at")
    )
    return first.filter(F.col("created_at") >= now - F.make_interval(mins=F.lit(minutes)))


def job_sessions(updates: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Activity sessions per job that close after ``minutes`` of silence."""
    return (
        updates.withWatermark("ts", late)
        .groupBy(F.session_window("ts", f"{minutes} minutes"), "job_id")
        .agg(F.count(F.lit(1)).alias("updates"), F.max_by("status", "ts").alias("status"))
        .select(
            "job_id",
            F.col("session_window.start").alias("start"),
            F.col("session_window.end").alias("end"),
            "updates",
            "status",
        )
    )
