"""Request counts and metrics over a log, as tables or as streams.

A log row has ts, ip, method, path, status and ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Window in minutes and most requests per address.
LIMITS = {"chat": (10, 30), "routes": (60, 50), "api": (15, 500)}


def request_counts(log: DataFrame, minutes: int, slide: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests per address and window; ``slide`` makes the windows overlap."""
    window = F.window("ts", f"{minutes} minutes", f"{slide} minutes" if slide else None)
    return (
        log.withWatermark("ts", late)
        .groupBy(window, "ip")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ip", "requests")
    )


def limited(log: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """``kind, start, end, ip, requests, over``: the counts of every limit, and whether they pass it."""
    parts = [
        request_counts(log, minutes).select(F.lit(kind).alias("kind"), "*", (F.col("requests") > most).alias("over"))
        for kind, (minutes, most) in limits.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def breaches(counts: DataFrame, most: int) -> DataFrame:
    return counts.filter(F.col("requests") > most)


def log_metrics(log: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean time per path and window."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes"), "path")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status") >= 500).alias("errors"),
            F.avg("ms").alias("mean_ms"),
            F.max("ms").alias("max_ms"),
        )
        .select(F.col("window.start").alias("start"), "path", "requests", "errors", "mean_ms", "max_ms")
    )
