"""Permit alerts as keyed state: one entry per date and per alert, timers for alerts that run out.

A batch touches only the permits in it, so what it writes grows with the batch
and not with all that is known.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cairn.operators.trips import date_list, is_open, notifications

SALTS = 16  # parts of a permit: alerts are dealt out over them, its few dates go to each
SENT = "permit_id string, alert string, outcome string, dates array<string>"
_EVENT = ["permit_id", "salt", "at", "date", "open", "alert", "same", "start"]


def _day(value: datetime.date) -> int:
    """Milliseconds of the beginning of a day."""
    return (value - datetime.date(1970, 1, 1)).days * 86_400_000


class _Permit(StatefulProcessor):
    """Dates and alerts of one part of a permit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dates = handle.getMapState("dates", "date string", "open boolean, seen_at long")
        self.alerts = handle.getMapState("alerts", "same string", "alert string, start string, sent string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        part = pd.concat(list(rows), ignore_index=True)
        part["micros"] = part["at"].astype("datetime64[us]").astype("int64")
        for r in part[part["date"].notna()].sort_values(["micros", "open"]).itertuples():
            known = self.dates.getValue((r.date,)) if self.dates.containsKey((r.date,)) else None
            if known is None or known[1] <= r.micros:
                self.dates.updateValue((r.date,), (bool(r.open), int(r.micros)))
        for r in part[part["alert"].notna()].sort_values(["micros", "alert"]).itertuples():
            if not self.alerts.containsKey((r.same,)) and (r.start is None or _day(datetime.date.fromisoformat(r.start)) >= now):
                self.alerts.updateValue((r.same,), (r.alert, r.start, None))
                if r.start is not None:
                    self.handle.registerTimer(_day(datetime.date.fromisoformat(r.start)) + 1)
        found = sorted(k[0] for k, v in self.dates.iterator() if v[0])
        out = []
        for (same,), (alert, start, sent) in list(self.alerts.iterator()):
            dates = [d for d in found if start is not None and d >= start and d[:7] == start[:7]]
            if dates and ",".join(dates) != sent:
                self.alerts.updateValue((same,), (alert, start, ",".join(dates)))
                out.append((key[0], alert, "notify", dates))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Alerts whose first day has begun are dropped."""
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (same,), (alert, start, _) in list(self.alerts.iterator()):
            if start is not None and _day(datetime.date.fromisoformat(start)) < now:
                self.alerts.removeKey((same,))
                out.append((key[0], alert, "expired", None))
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[i] for r in out], dtype="object") for i, n in enumerate(("permit_id", "alert", "outcome", "dates"))})

    def close(self) -> None:
        pass


def watched(changes: DataFrame, asked: DataFrame, registry: DataFrame, late: str = "0 seconds") -> DataFrame:
    """What happens to alerts, from a stream of slots and a stream of alerts: ``notify`` or ``expired`` rows.

    ``changes``: permit_id, date, status, seen_at. ``asked``: alerts as in the
    alert table; its region's permit comes from ``registry``, and an alert without
    one is not watched. The watermark over ``seen_at`` and ``created_at`` is the
    clock: an alert is dropped once its start date lies before it. One that
    repeats address, region and start date of a known alert is left out; a
    missing date equals a missing date. The whole sorted set of open dates in the
    start's month is compared with the set sent last, so a revised slot notifies
    again and an unchanged set does not; a slot older than the known one changes
    nothing. Needs the RocksDB state store.
    """
    start = F.col("start_date").cast("string")
    same = F.concat_ws("\x1f", F.coalesce("email", F.lit("")), F.col("region_id").cast("string"), F.coalesce(start, F.lit("")))
    permits = registry.select("region_id", "permit_id", "permit_name", "booking_url")
    alerts = (
        asked.join(permits, "region_id")
        .filter("permit_id is not null")
        .select(
            "permit_id",
            F.pmod(F.xxhash64(same), F.lit(SALTS)).cast("int").alias("salt"),
            F.col("created_at").alias("at"),
            F.lit(None).cast("string").alias("date"),
            F.lit(None).cast("boolean").alias("open"),
            F.to_json(F.struct("id", "email", "region_id", "start_date", "end_date", "permit_name", "booking_url")).alias("alert"),
            same.alias("same"),
            start.alias("start"),
        )
    )
    slots = changes.filter("permit_id is not null and date is not null").select(
        "permit_id",
        F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"),
        F.col("seen_at").alias("at"),
        F.col("date").cast("string").alias("date"),
        F.coalesce(is_open(F.col("status")), F.lit(False)).alias("open"),
        *[F.lit(None).cast("string").alias(c) for c in ("alert", "same", "start")],
    )
    sent = (
        slots.select(*_EVENT)
        .unionByName(alerts.select(*_EVENT))
        .filter("at is not null")
        .withWatermark("at", late)
        .groupBy("permit_id", "salt")
        .transformWithStateInPandas(_Permit(), outputStructType=SENT, outputMode="append", timeMode="eventTime")
    )
    fields = "id string, email string, region_id string, start_date date, end_date date, permit_name string, booking_url string"
    return sent.withColumn("alert", F.from_json("alert", fields)).select("permit_id", "outcome", "dates", "alert.*")


def messages(sent: DataFrame) -> DataFrame:
    """The notifications among the rows of ``watched``."""
    dates: Column = F.transform("dates", lambda d: d.cast("date"))
    return notifications(sent.withColumn("date_list", date_list(dates)))
