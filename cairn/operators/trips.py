"""Regions, permits, weather and alerts around a trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.geo import half_up, round_to
from cairn.functions.text import grams, slug
from cairn.functions.trip import NORMAL_YEARS, date_list, is_open, next_saturdays, weather_source, weather_text

# Fixed values.


# --- regions ---------------------------------------------------------------


def resolve_region(asked: DataFrame, regions: DataFrame) -> DataFrame:
    """Region of a free-text query: by id, by name, or by part of a name.

    ``asked``: query_id, query. ``regions``: region_id, name. Of several hits
    the first by name wins. Queries are reduced to distinct texts, and parts of
    names are met by their first characters, so no query is compared with every
    region.
    """
    wanted = asked.select(F.lower("query").alias("q"), F.col("query").alias("raw")).distinct()
    named = regions.select("region_id", "name", F.lower("name").alias("lname"))
    by_id = wanted.join(named, F.col("raw") == F.col("region_id").cast("string"))
    indexed = named.withColumn("gram", F.explode(grams(F.col("lname"))))
    by_part = (
        wanted.withColumn("gram", F.substring("q", 1, 3))
        .join(indexed, "gram")
        .filter(F.col("lname").contains(F.col("q")))
        .drop("gram")
    )
    hits = (
        by_id.select("raw", "region_id", "name")
        .unionByName(by_part.select("raw", "region_id", "name"))
        .groupBy("raw")
        .agg(F.min(F.struct("name", "region_id")).alias("hit"))
    )
    return asked.join(hits, asked["query"] == hits["raw"], "left").select(
        *[asked[c] for c in asked.columns], F.col("hit.region_id").alias("region_id"), F.col("hit.name").alias("name")
    )


def locate_region(asked: DataFrame, regions: DataFrame) -> DataFrame:
    """Region of a place name: equal names first, else the slug of the text is the id.

    ``asked``: query_id, location. ``regions``: slug_id, name.
    """
    by_name = regions.groupBy(F.lower("name").alias("key")).agg(F.min("slug_id").alias("name_hit"))
    by_slug = regions.select(F.col("slug_id").alias("slug_key")).distinct()
    return (
        asked.withColumn("key", F.lower("location"))
        .withColumn("slug_key", slug(F.col("location")))
        .join(by_name, "key", "left")
        .join(by_slug.withColumn("slug_hit", F.col("slug_key")), "slug_key", "left")
        .select(*asked.columns, F.coalesce("name_hit", "slug_hit").alias("slug_id"))
    )


def readiness(regions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Regions with a flag that route data exists."""
    have = clusters.select("region_id").distinct().withColumn("_have", F.lit(True))
    return regions.join(have, "region_id", "left").withColumn(
        "ready", F.coalesce("_have", F.lit(False))
    ).drop("_have")


# --- permits ---------------------------------------------------------------


def permit_info(regions: DataFrame, registry: DataFrame) -> DataFrame:
    """Permit rules per region; a region the registry does not know needs none."""
    known = registry.withColumn("listed", F.lit(True))
    return regions.join(known, "region_id", "left").withColumn(
        "permit_required", F.coalesce("permit_required", F.lit(False))
    ).withColumn("listed", F.coalesce("listed", F.lit(False)))


def open_dates(requests: DataFrame, availability: DataFrame) -> DataFrame:
    """Open dates on or after the start of each request.

    ``requests``: permit_id, start_date and what else they carry.
    ``availability``: permit_id, date, status. The range test is part of the equi join.
    """
    slots = availability.filter(is_open(F.col("status"))).select("permit_id", "date").distinct()
    return requests.join(slots, "permit_id").filter(F.col("date") >= F.col("start_date"))


def available_counts(requests: DataFrame, availability: DataFrame) -> DataFrame:
    """Number of open dates, whether there is any, and the dates as one sorted key.

    Requests for the same permit and start date share one lookup.
    """
    same = ["permit_id", "start_date"]
    found = (
        open_dates(requests.select(*same).distinct(), availability)
        .groupBy(*same)
        .agg(
            F.count(F.lit(1)).alias("available_count"),
            F.array_join(F.array_sort(F.collect_set(F.col("date").cast("string"))), ",").alias("dates_key"),
        )
    )
    return requests.join(found, same, "left").select(
        "request_id",
        F.coalesce("available_count", F.lit(0)).cast("long").alias("available_count"),
        (F.coalesce("available_count", F.lit(0)) > 0).alias("available"),
        F.coalesce("dates_key", F.lit("")).alias("dates_key"),
    )


def slot_date(key: Column) -> Column:
    """Date of an availability key, ``2024-07-06`` or ``2024-07-06T00:00:00Z``."""
    return F.try_to_date(F.substring(key, 1, 10))


def weekend_open(permits: DataFrame, availability: DataFrame, today: Column) -> DataFrame:
    """Whether any of the next two Saturdays is open, per permit."""
    wanted = permits.select("permit_id").distinct().withColumn("date", F.explode(next_saturdays(today)))
    slots = availability.groupBy("permit_id", "date").agg(
        F.bool_or(is_open(F.col("status"))).alias("open")
    )
    return (
        wanted.join(slots, ["permit_id", "date"], "left")
        .groupBy("permit_id")
        .agg(F.bool_or(F.coalesce("open", F.lit(False))).alias("weekend_open"))
    )


def bookable_now(regions: DataFrame, registry: DataFrame, availability: DataFrame, today: Column) -> DataFrame:
    """Ready regions one can book for the next two weekends, with what a traveller needs to book.

    No permit needed is fine; a lottery or an unlisted region is not; otherwise
    a listed Saturday must be open.
    """
    info = permit_info(regions, registry)
    weekend = weekend_open(registry.filter("permit_id is not null"), availability, today)
    free = ~F.col("permit_required")
    return (
        info.join(weekend, "permit_id", "left")
        .filter(F.col("ready") & F.col("listed"))
        .withColumn(
            "available",
            F.when(free, True)
            .when(F.coalesce("is_lottery", F.lit(False)), False)
            .when(F.col("permit_id").isNull(), False)
            .otherwise(F.coalesce("weekend_open", F.lit(False))),
        )
        .filter("available")
        .select(
            "region_id", "name", "available", "permit_required", F.lit(False).alias("is_lottery"),
            F.when(~free, F.col("booking_url")).alias("booking_url"),
            "best_months", next_saturdays(today).alias("weekends"),
        )
    )


# --- weather ---------------------------------------------------------------


def trip_weather(routes: DataFrame, forecast: DataFrame, normals: DataFrame, today: Column) -> DataFrame:
    """One weather row per trip day from the forecast, or one of climate normals.

    ``routes``: route_id, place_id, start_date, days. ``forecast``: place_id,
    date, high_f, low_f, precip_in, code. ``normals``: place_id, month_day,
    avg_high_f, avg_low_f, avg_precip_in.
    """
    until = F.datediff("start_date", today)
    planned = routes.withColumn("source", F.coalesce(weather_source(until), F.lit("climate_normals"))).withColumn(
        "month_day", F.date_format(F.coalesce("start_date", today), "MM-dd")
    )
    days = planned.filter("source = 'forecast' and days > 0").withColumn(
        "date", F.explode(F.expr("sequence(start_date, date_add(start_date, cast(days as int) - 1))"))
    )
    near = days.join(forecast, ["place_id", "date"], "left").select(
        "route_id",
        "source",
        "date",
        F.col("high_f").alias("high_f"),
        F.col("low_f").alias("low_f"),
        F.col("precip_in").alias("precip_in"),
        weather_text(F.col("code")).alias("description"),
    )
    far = planned.filter("source = 'climate_normals'").join(normals, ["place_id", "month_day"], "left").select(
        "route_id",
        "source",
        F.lit(None).cast("date").alias("date"),
        F.col("avg_high_f").cast("double").alias("high_f"),
        F.col("avg_low_f").cast("double").alias("low_f"),
        F.col("avg_precip_in").alias("precip_in"),
        F.lit(None).cast("string").alias("description"),
    )
    return near.unionByName(far)


def climate_normals(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Mean high, low (rounded) and precipitation (two decimals). ``daily``: high_f, low_f, precip_in."""
    return daily.groupBy(*keys).agg(
        half_up(F.avg("high_f")).alias("avg_high_f"),
        half_up(F.avg("low_f")).alias("avg_low_f"),
        round_to(F.avg("precip_in"), 2).alias("avg_precip_in"),
    )


def calendar_window(daily: DataFrame, month_days: DataFrame, all_days: bool = False) -> DataFrame:
    """Daily rows of the normal years that count for a reference ``month_day``.

    The calendar day itself by default; ``all_days`` takes every day between
    that day of the first and of the last year.
    """
    years = daily.filter(F.year("date").between(*NORMAL_YEARS))
    if not all_days:
        return years.withColumn("month_day", F.date_format("date", "MM-dd")).join(
            month_days, ["place_id", "month_day"], "left_semi"
        )
    bounds = month_days.select(
        "place_id",
        "month_day",
        F.try_to_date(F.concat(F.lit(f"{NORMAL_YEARS[0]}-"), F.col("month_day"))).alias("first_day"),
        F.try_to_date(F.concat(F.lit(f"{NORMAL_YEARS[1]}-"), F.col("month_day"))).alias("last_day"),
    )
    return years.join(bounds, "place_id").filter(
        F.col("date").between(F.col("first_day"), F.col("last_day"))
    ).drop("first_day", "last_day")


# --- alerts ----------------------------------------------------------------


def add_alerts(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """Append alerts that are not there yet for the same address, region and start date.

    Missing start dates count as equal. Repeats within ``new`` are added once.
    """
    def key(df: DataFrame) -> DataFrame:
        return df.withColumn("_start", F.coalesce(F.col("start_date").cast("string"), F.lit("")))

    same = ["email", "region_id", "_start"]
    fresh = (
        key(new)
        .join(key(alerts).select(*same), same, "left_anti")
        .groupBy(*same)
        .agg(F.min_by(F.struct(*alerts.columns), "id").alias("a"))
        .select("a.*")
    )
    return alerts.unionByName(fresh)


def remove_alerts(alerts: DataFrame, emails: DataFrame) -> DataFrame:
    """Alerts of other addresses."""
    return alerts.join(emails.select("email").distinct(), "email", "left_anti")


def removed_counts(alerts: DataFrame, emails: DataFrame) -> DataFrame:
    """Alerts removed per address, zero included."""
    hits = alerts.groupBy("email").agg(F.count(F.lit(1)).alias("n"))
    return emails.select("email").distinct().join(hits, "email", "left").select(
        "email", F.coalesce("n", F.lit(0)).cast("long").alias("removed")
    )


def check_alerts(alerts: DataFrame, registry: DataFrame, availability: DataFrame, now: Column) -> DataFrame:
    """Every alert with what happens to it: expired, no_permit, unchanged, none or notify.

    ``now`` is a timestamp. An alert is sent when the sorted set of open dates
    is not empty and differs from the set sent last. Without a start date
    availability is not checked. Availability is joined from a table of permits
    and dates that alerts ask for, each pair once, however many alerts share it.
    """
    info = registry.select("region_id", "permit_id", "permit_name", "booking_url")
    live = alerts.join(info, "region_id", "left").withColumn(
        "expired", F.coalesce(F.col("start_date").cast("timestamp") < now, F.lit(False))
    )
    asked = (
        live.filter("not expired and permit_id is not null and start_date is not null")
        .select("permit_id", "start_date")
        .distinct()
    )
    found = (
        open_dates(asked, availability)
        .filter(F.trunc("date", "MM") == F.trunc("start_date", "MM"))
        .groupBy("permit_id", "start_date")
        .agg(F.array_sort(F.collect_set(F.col("date").cast("string"))).alias("dates"))
    )
    key = F.array_join("dates", ",")
    outcome = (
        F.when(F.col("expired"), "expired")
        .when(F.col("permit_id").isNull(), "no_permit")
        .when(F.col("dates").isNull(), "none")
        .when(key.eqNullSafe(F.col("last_notified")), "unchanged")
        .otherwise("notify")
    )
    return (
        live.join(found, ["permit_id", "start_date"], "left")
        .withColumn("outcome", outcome)
        .withColumn("dates_key", key)
        .withColumn("date_list", date_list(F.col("dates")))
    )


def next_alerts(checked: DataFrame, now: Column) -> DataFrame:
    """The alert table after a check: expired ones gone, sent sets remembered."""
    looked = F.col("outcome").isin("notify", "none")
    return checked.filter("outcome <> 'expired'").select(
        "id",
        "email",
        "region_id",
        "start_date",
        "end_date",
        "created_at",
        F.when(looked, now).otherwise(F.col("last_checked")).alias("last_checked"),
        F.when(F.col("outcome") == "notify", F.col("dates_key")).otherwise(F.col("last_notified")).alias("last_notified"),
    )


def notifications(checked: DataFrame) -> DataFrame:
    return checked.filter("outcome = 'notify'").select(
        "id",
        "email",
        F.concat(F.lit("Open dates: "), F.coalesce("permit_name", F.col("region_id").cast("string"))).alias("subject"),
        "date_list",
        "start_date",
        "end_date",
        F.coalesce("booking_url", F.lit("https://www.recreation.gov")).alias("booking_url"),
    )
