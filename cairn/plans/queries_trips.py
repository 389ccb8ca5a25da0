"""Queries over regions, permits, weather, alerts, documents and streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geo, text, trip
from cairn.operators import itinerary as it, trips
from cairn.plans.queries_itinerary import entries, geometry, given, main, segments, violations, ALL_RULES
from cairn.plans.queries_network import SEGMENTS, elements, raw_segments
from cairn.plans.registry import half, query, r1, r3
from cairn.plans.views import kept, network, table, view
from cairn.session import Stages
from cairn.sources import documents, files, schemas
from cairn.streaming import folds, traffic, windows

TODAY = "2024-01-10"


def today():
    return F.lit(TODAY).cast("date")


# --- preferences -----------------------------------------------------------


@query("prj8", "select pref_id, case when scenery_text = '' then 'lakes,peaks' else scenery_text end as scenery from prefs")
def prj8(spark, sf):
    words = F.filter(F.split("scenery_text", ","), lambda w: w != "")
    return view(spark, sf, "prefs").select("pref_id", F.array_join(trip.scenery_or_default(words), ",").alias("scenery"))


@query(
    "prj9",
    """with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(ceil(epoch(l_shipdate - o_orderdate) / 86400) as bigint) as n
         from lineitem join orders on l_orderkey = o_orderkey)
       select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when n > 0 then n end as days from d""",
)
def prj9(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", trip.days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("days")
    )


@query(
    "prj10",
    """with p as (select c_custkey, c_custkey % 17 as days, cast(c_custkey % 29 as double) as mi, case c_nationkey % 4 when 0 then 'easy' when 1 then 'moderate' when 2 then 'hard' else 'any' end as tol,
         case c_custkey % 3 when 0 then 'soon' when 1 then '' else '2024-07-01' end as start from customer)
       select c_custkey, case when days < 1 or days > 14 then 1 else 0 end + case when mi < 3 or mi > 25 then 1 else 0 end
         + case when tol = 'any' then 1 else 0 end + case when start = 'soon' then 1 else 0 end as errors from p""",
)
def prj10(spark, sf):
    c = table(spark, sf, "customer")
    tol = F.element_at(F.array(*[F.lit(x) for x in ("easy", "moderate", "hard", "any")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    start = F.when(F.col("c_custkey") % 3 == 0, "soon").when(F.col("c_custkey") % 3 == 1, "").otherwise("2024-07-01")
    errors = trip.preference_errors(F.col("c_custkey") % 17, (F.col("c_custkey") % 29).cast("double"), tol, start)
    return c.select("c_custkey", F.size(errors).alias("errors"))


@query(
    "prj11",
    f"""select pref_id, case tolerance when 'easy' then 'low' when 'hard' then 'hard' else tolerance end as raw,
          case tolerance when 'easy' then 'easy' when 'hard' then 'hard' else tolerance end as tolerance,
          {r1("(miles_per_day * 5 + pref_id % 3) / days")} as miles_per_day, replace(scenery_text, ',', ', ') as scenery from prefs""",
)
def prj11(spark, sf):
    p = view(spark, sf, "prefs")
    raw = F.when(F.col("tolerance") == "easy", "low").otherwise(F.col("tolerance"))
    return p.select(
        "pref_id", raw.alias("raw"), trip.normal_tolerance(raw).alias("tolerance"),
        geo.round_to((F.col("miles_per_day") * 5 + F.col("pref_id") % 3) / F.col("days"), 1).alias("miles_per_day"),
        F.array_join(F.split("scenery_text", ","), ", ").alias("scenery"),
    )


@query("fn28", f"select pref_id, {r1('miles_per_day * 7 / days')} as pace from prefs")
def fn28(spark, sf):
    return view(spark, sf, "prefs").select("pref_id", trip.implied_pace(F.col("miles_per_day") * 7, F.col("days")).alias("pace"))


# --- regions ---------------------------------------------------------------

_ASKED = """asked as (select c_custkey as query_id, case c_custkey % 4 when 0 then 'NATION_' || cast(c_nationkey as varchar)
      when 1 then 'nation_' || cast(c_nationkey % 3 as varchar) when 2 then cast(c_nationkey as varchar) else 'elsewhere' end as query from customer)"""


def asked(spark, sf):
    k = F.col("c_nationkey")
    words = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("NATION_"), k.cast("string")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("nation_"), (k % 3).cast("string")))
        .when(F.col("c_custkey") % 4 == 2, k.cast("string"))
        .otherwise("elsewhere")
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), words.alias("query"))


@query(
    "join11",
    f"""with {_ASKED}, hit as (select a.query_id, r.region_id, r.name, row_number() over (partition by a.query_id order by r.name) as n
          from asked a join regions r on cast(r.region_id as varchar) = a.query or contains(lower(r.name), lower(a.query)))
        select a.query_id, h.region_id, h.name from asked a left join hit h on h.query_id = a.query_id and n = 1""",
)
def join11(spark, sf):
    return trips.resolve_region(asked(spark, sf), view(spark, sf, "regions")).select("query_id", "region_id", "name")


@query(
    "join12",
    """select c_custkey as query_id, case when c_custkey % 3 = 2 then null else 'nation_' || cast(c_nationkey as varchar) end as slug_id from customer""",
)
def join12(spark, sf):
    k = F.col("c_nationkey").cast("string")
    where = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Nation No "), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("NATION? "), k))
        .otherwise("nowhere")
    )
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), where.alias("location"), F.col("c_custkey").alias("k"))
    regions = table(spark, sf, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("slug_id"),
        F.concat(F.lit("nation no "), F.col("n_nationkey").cast("string")).alias("name"),
    )
    return trips.locate_region(q, regions).select("query_id", F.regexp_replace("slug_id", "-", "_").alias("slug_id"))


@query("join13", "select region_id, name, region_id in (select c_nationkey from customer where c_acctbal > 9000) as ready from regions")
def join13(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("region_id"))
    return trips.readiness(view(spark, sf, "regions"), rich)


@query(
    "join14",
    """select r.region_id, r.name, coalesce(permit_required, false) as permit_required, permit_id, g.region_id is not null as listed
       from regions r left join registry g on g.region_id = r.region_id""",
)
def join14(spark, sf):
    return trips.permit_info(view(spark, sf, "regions"), view(spark, sf, "registry")).select(
        "region_id", "name", "permit_required", "permit_id", "listed"
    )


def requests(spark, sf):
    return view(spark, sf, "alerts").filter("start_date is not null").select(
        F.col("id").alias("request_id"), F.concat(F.lit("p"), F.col("region_id").cast("string")).alias("permit_id"), "start_date"
    )


_OPEN = """open as (select distinct permit_id, date from slots where status in ('Available', 'AVAILABLE')),
    asks as (select id as request_id, 'p' || cast(region_id as varchar) as permit_id, start_date from alerts where start_date is not null)"""


@query("join15", f"with {_OPEN} select a.request_id, o.date from asks a join open o on o.permit_id = a.permit_id and o.date >= a.start_date")
def join15(spark, sf):
    return trips.open_dates(requests(spark, sf), view(spark, sf, "slots")).select("request_id", "date")


@query(
    "agg18",
    f"""with {_OPEN}, f as (select a.request_id, count(*) as n, string_agg(cast(o.date as varchar), ',' order by o.date) as k
          from asks a join open o on o.permit_id = a.permit_id and o.date >= a.start_date group by 1)
        select a.request_id, coalesce(n, 0) as available_count, coalesce(n, 0) > 0 as available, coalesce(k, '') as dates_key
        from asks a left join f on f.request_id = a.request_id""",
)
def agg18(spark, sf):
    return trips.available_counts(requests(spark, sf), view(spark, sf, "slots"))


_SATURDAYS = f"""sat as (select date '{TODAY}' + cast((6 - dayofweek(date '{TODAY}') + 7) % 7 as int) as date
      union all select date '{TODAY}' + cast((6 - dayofweek(date '{TODAY}') + 7) % 7 as int) + 7)"""


@query(
    "join16",
    f"""with {_SATURDAYS} select p.permit_id, coalesce(bool_or(status in ('Available', 'AVAILABLE')), false) as weekend_open
        from (select distinct permit_id from registry where permit_id is not null) p left join (select s.* from slots s join sat on sat.date = s.date) s
          on s.permit_id = p.permit_id group by 1""",
)
def join16(spark, sf):
    permits = view(spark, sf, "registry").filter("permit_id is not null")
    return trips.weekend_open(permits, view(spark, sf, "slots"), today())


@query(
    "prj17",
    f"""
    with {_SATURDAYS}, w as (select permit_id, bool_or(status in ('Available', 'AVAILABLE')) as o from slots s join sat on sat.date = s.date group by 1),
    ready as (select region_id, name, region_id in (select c_nationkey from customer where c_acctbal > 9000) as ready from regions)
    select r.region_id, r.name, true as available, g.permit_required, false as is_lottery,
      case when g.permit_required then booking_url end as booking_url, coalesce(array_to_string(best_months, '/'), '') as best_months,
      (select string_agg(cast(date as varchar), '/' order by date) from sat) as weekends
    from ready r join registry g on g.region_id = r.region_id left join w on w.permit_id = g.permit_id
    where r.ready and (not g.permit_required or (not g.is_lottery and g.permit_id is not null and coalesce(o, false)))""",
)
def prj17(spark, sf):
    found = trips.bookable_now(join13(spark, sf), view(spark, sf, "registry"), view(spark, sf, "slots"), today())
    return found.withColumn("best_months", F.coalesce(F.array_join("best_months", "/"), F.lit(""))).withColumn(
        "weekends", F.array_join(F.transform("weekends", lambda d: d.cast("string")), "/")
    )


@query(
    "prj15",
    """select id, case when id like '%7' then 'email address is malformed' when id like '%3' then 'region id is malformed'
         when not coalesce(permit_required, false) then 'region has no permits to watch' end as error
       from alerts a left join registry g on g.region_id = a.region_id""",
)
def prj15(spark, sf):
    a = view(spark, sf, "alerts").join(view(spark, sf, "registry"), "region_id", "left")
    email = F.when(F.col("id").endswith("7"), F.regexp_replace("email", "@", " at ")).otherwise(F.col("email"))
    region = F.when(F.col("id").endswith("3"), F.lit("Bad Region")).otherwise(F.col("region_id").cast("string"))
    return a.select("id", trip.alert_error(email, region, F.col("permit_required")).alias("error"))


@query(
    "fn19",
    """select region_id, case when not permit_required then 'No permit' when is_lottery and region_id % 2 = 1 and region_id > 8 then 'Draw from Mar 5'
         when is_lottery then 'By draw' when region_id % 3 = 0 then 'Needs a permit' when region_id % 3 = 1 then 'Open on ' || cast(region_id as varchar) || ' days'
         else 'Full on these days' end as badge from registry""",
)
def fn19(spark, sf):
    r, k = view(spark, sf, "registry"), F.col("region_id")
    opens = F.when((k % 2 == 1) & (k > 8), "03-05")
    return r.select(
        "region_id", trip.permit_badge(F.col("permit_required"), F.col("is_lottery"), opens, k % 3 != 0, k % 3 == 1, k).alias("badge")
    )


@query("fn20", "select way_id, replace(lower(name), ' ', '-') as slug, replace(lower(name), ' ', '-') as file from ways where name is not null")
def fn20(spark, sf):
    w = view(spark, sf, "ways").filter("name is not null")
    return w.select("way_id", text.slug(F.col("name")).alias("slug"), text.file_slug(F.col("name")).alias("file"))


@query("fn15", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as first_day, last_day(o_orderdate) as end_day from orders")
def fn15(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", trip.month_start(d).alias("first_day"), trip.month_end(d).alias("end_day"))


@query(
    "fn16",
    """with d as (select o_orderkey, cast(o_orderdate as date) as d from orders), s as (select o_orderkey, d + cast((6 - dayofweek(d) + 7) % 7 as int) as a from d)
       select o_orderkey, cast(a as varchar) || ',' || cast(a + 7 as varchar) as saturdays from s""",
)
def fn16(spark, sf):
    days = trip.next_saturdays(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(days, lambda d: d.cast("string")), ",").alias("saturdays"))


@query(
    "fn12",
    """with e as (select event_id, event_id % 101 as code from events)
       select event_id, case when code = 0 then 'Clear sky' when code <= 2 then 'Partly cloudy' when code = 3 then 'Overcast' when code <= 49 then 'Fog'
         when code <= 59 then 'Drizzle' when code <= 69 then 'Rain' when code <= 79 then 'Snow' when code <= 84 then 'Rain showers'
         when code <= 94 then 'Thunderstorm' else 'Severe thunderstorm' end as sky from e""",
)
def fn12(spark, sf):
    return table(spark, sf, "events").select("event_id", trip.weather_text(F.col("event_id") % 101).alias("sky"))


@query(
    "fn26",
    f"""with {_OPEN}, f as (select a.request_id, count(*) as n, list_sort(list(cast(o.date as varchar))) as d
          from asks a join open o on o.permit_id = a.permit_id and o.date >= a.start_date group by 1)
        select request_id, array_to_string(d[1:5], ', ') || case when n > 5 then ' +' || cast(n - 5 as varchar) || ' more' else '' end as dates from f""",
)
def fn26(spark, sf):
    found = trips.open_dates(requests(spark, sf), view(spark, sf, "slots"))
    dates = found.groupBy("request_id").agg(F.array_sort(F.collect_set(F.col("date").cast("string"))).alias("d"))
    return dates.select("request_id", trip.date_list(F.col("d")).alias("dates"))


@query(
    "fn27",
    f"""with p as (select id, start_date, 1 + cast(id as bigint) % 4 as days, strftime(coalesce(start_date, date '{TODAY}'), '%m-%d') as month_day,
          case when start_date between date '{TODAY}' and date '{TODAY}' + 16 then 'forecast' else 'climate_normals' end as source from alerts)
        select id, source, month_day, case source when 'forecast' then cast(start_date as varchar) else '1991-' || month_day end as first_day,
          case source when 'forecast' then cast(cast(start_date + cast(days - 1 as int) as date) as varchar) else '2020-' || month_day end as last_day from p""",
)
def fn27(spark, sf):
    """Trips of one to four days from the dates of the alerts."""
    days = F.col("id").cast("long") % 4 + 1
    return view(spark, sf, "alerts").select("id", trip.weather_window(F.col("start_date"), days, today()).alias("w")).select("id", "w.*")


# --- weather ---------------------------------------------------------------

_WEATHER = f"""
    forecast as (select user_id % 25 as place_id, cast(ts as date) as date, max(value) as high_f, min(value) as low_f, count(*) as code from events group by 1, 2),
    normals as (select o_custkey % 25 as place_id, strftime(o_orderdate, '%m-%d') as month_day, {half("avg(o_totalprice)")} as avg_high_f from orders group by 1, 2),
    plan as (select cast(id as bigint) as route_id, region_id as place_id, start_date, 1 + cast(id as bigint) % 3 as days,
        case when start_date between date '{TODAY}' and date '{TODAY}' + 16 then 'forecast' else 'climate_normals' end as source,
        strftime(coalesce(start_date, date '{TODAY}'), '%m-%d') as month_day from alerts)"""


@query(
    "join17",
    f"""
    with {_WEATHER}, d as (select *, unnest(range(0, days)) as n from plan where source = 'forecast')
    select route_id, source, cast(start_date + cast(n as int) as date) as date, f.high_f, f.low_f from d left join forecast f on f.place_id = d.place_id and f.date = d.start_date + cast(n as int)
    union all select route_id, source, null, cast(avg_high_f as double), null from plan p left join normals n on n.place_id = p.place_id and n.month_day = p.month_day where source = 'climate_normals'""",
)
def join17(spark, sf):
    ev, od = table(spark, sf, "events"), table(spark, sf, "orders")
    forecast = ev.groupBy((F.col("user_id") % 25).alias("place_id"), F.to_date("ts").alias("date")).agg(
        F.max("value").alias("high_f"), F.min("value").alias("low_f"), F.lit(0.0).alias("precip_in"), F.count(F.lit(1)).alias("code")
    )
    daily = od.select((F.col("o_custkey") % 25).alias("place_id"), F.date_format("o_orderdate", "MM-dd").alias("month_day"), F.col("o_totalprice").alias("high_f"), F.col("o_totalprice").alias("low_f"), F.lit(0.0).alias("precip_in"))
    routes = view(spark, sf, "alerts").select(
        F.col("id").cast("long").alias("route_id"), F.col("region_id").alias("place_id"), "start_date", (F.col("id").cast("long") % 3 + 1).alias("days")
    )
    normals = trips.climate_normals(daily, ["place_id", "month_day"]).withColumn("avg_low_f", F.lit(None).cast("long"))
    return trips.trip_weather(routes, forecast, normals, today()).select("route_id", "source", "date", "high_f", "low_f")


@query(
    "agg17",
    f"""select o_custkey as place_id, {half("avg(o_totalprice / 1000)")} as avg_high_f, {half("avg(o_totalprice / 2000)")} as avg_low_f,
          floor(avg(o_totalprice / 1e6) * 100e0 + 0.5e0) / 100e0 as avg_precip_in from orders group by 1""",
)
def agg17(spark, sf):
    price = F.col("o_totalprice")
    daily = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("place_id"), (price / 1000).alias("high_f"), (price / 2000).alias("low_f"), (price / 1e6).alias("precip_in")
    )
    return trips.climate_normals(daily, ["place_id"])


@query(
    "agg17_calendar",
    f"""with asked as (select distinct region_id as place_id, strftime(coalesce(start_date, date '{TODAY}'), '%m-%d') as month_day from alerts),
          d as (select o_custkey % 25 as place_id, strftime(o_orderdate, '%m-%d') as month_day, o_totalprice as p from orders where year(o_orderdate) between 1991 and 2020)
        select place_id, month_day, {half("avg(p / 1000)")} as avg_high_f, {half("avg(p / 2000)")} as avg_low_f, floor(avg(p / 1e6) * 100e0 + 0.5e0) / 100e0 as avg_precip_in
        from d join asked using (place_id, month_day) group by 1, 2""",
)
def agg17_calendar(spark, sf):
    """Normals of the calendar days that the alerts ask for, over the normal years."""
    price = F.col("o_totalprice")
    daily = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("place_id"), F.col("o_orderdate").alias("date"), (price / 1000).alias("high_f"), (price / 2000).alias("low_f"), (price / 1e6).alias("precip_in")
    )
    window = trip.weather_window(F.col("start_date"), F.lit(1), today())
    asked = view(spark, sf, "alerts").select(F.col("region_id").alias("place_id"), window["month_day"].alias("month_day"))
    return trips.climate_normals(trips.calendar_window(daily, asked), ["place_id", "month_day"])


# --- alerts ----------------------------------------------------------------


def alert_rows(spark, sf):
    a = view(spark, sf, "alerts")
    none = F.lit(None)
    sent = F.when(F.col("id").cast("long") % 6 == 0, F.lit("2024-01-31"))
    return a.select(
        "id", "email", "region_id", "start_date", none.cast("date").alias("end_date"), none.cast("timestamp").alias("created_at"),
        none.cast("timestamp").alias("last_checked"), sent.alias("last_notified"),
    )


@query(
    "set6",
    """with new as (select cast(id as bigint) + 10000000 as id, email, (region_id + cast(id as bigint) % 2) % 25 as region_id, start_date from alerts),
       fresh as (select email, region_id, start_date, min(cast(id as varchar)) as id from new n where not exists (
         select 1 from alerts a where a.email = n.email and a.region_id = n.region_id and a.start_date is not distinct from n.start_date) group by 1, 2, 3)
       select id, email, region_id, start_date from alerts union all select id, email, region_id, start_date from fresh""",
)
def set6(spark, sf):
    alerts = alert_rows(spark, sf)
    k = F.col("id").cast("long")
    new = alerts.withColumn("region_id", (F.col("region_id") + k % 2) % 25).withColumn("id", (k + 10000000).cast("string"))
    return trips.add_alerts(alerts, new).select("id", "email", "region_id", "start_date")


_CHECK = f"""
    open as (select distinct permit_id, date from slots where status in ('Available', 'AVAILABLE')),
    live as (select a.*, g.permit_id, case when cast(id as bigint) % 6 = 0 then '2024-01-31' end as last_notified from alerts a left join registry g on g.region_id = a.region_id),
    found as (select l.id, string_agg(cast(o.date as varchar), ',' order by o.date) as k from live l join open o on o.permit_id = l.permit_id and o.date >= l.start_date
        and date_trunc('month', o.date) = date_trunc('month', l.start_date) where l.start_date >= date '{TODAY}' group by 1)"""


@query(
    "str2",
    f"""with {_CHECK} select l.id, case when start_date < date '{TODAY}' then 'expired' when permit_id is null then 'no_permit' when k is null then 'none'
          when k = last_notified then 'unchanged' else 'notify' end as outcome, k as dates_key from live l left join found f on f.id = l.id""",
)
def str2(spark, sf):
    checked = trips.check_alerts(alert_rows(spark, sf), view(spark, sf, "registry"), view(spark, sf, "slots"), F.lit(TODAY).cast("timestamp"))
    return checked.select("id", "outcome", "dates_key")


# --- folds and logs --------------------------------------------------------

TAG = "prefs"
BLOCK = "region string, notes string, sceneryPreferences array<string>, ready boolean"


def chat(spark, sf):
    """Assistant turns that end in a tagged block."""
    t = F.col("turn")
    block = F.to_json(
        F.struct(
            F.when(t % 2 == 1, F.concat(F.lit("r"), F.col("conv_id").cast("string"))).alias("region"),
            F.when(t % 3 == 0, "").otherwise(F.concat(F.lit("n"), t.cast("string"))).alias("notes"),
            F.when(t % 4 == 1, F.array(F.lit("lakes"), t.cast("string"))).otherwise(F.array().cast("array<string>")).alias("sceneryPreferences"),
            (t % 5 == 0).alias("ready"),
        )
    )
    said = F.concat(F.lit("  "), F.col("text"), F.lit(f" <{TAG}>\n"), block, F.lit(f"</{TAG}>\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", said.alias("said"))


def blocks(spark, sf):
    b = documents.tagged_block(F.col("said"), TAG, BLOCK)
    return chat(spark, sf).select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", "b.*")


@query(
    "src10",
    """select conv_id, turn, case when turn % 2 = 1 then 'r' || cast(conv_id as varchar) end as region, turn % 5 = 0 as ready,
         regexp_replace(text, '^\\s+|\\s+$', '', 'g') as reply from conversations""",
)
def src10(spark, sf):
    b = documents.tagged_block(F.col("said"), TAG, BLOCK)
    return chat(spark, sf).select(
        "conv_id", "turn", b["region"].alias("region"), b["ready"].alias("ready"), documents.without_blocks(F.col("said"), TAG).alias("reply")
    )


@query(
    "str1",
    """select conv_id, arg_max('r' || cast(conv_id as varchar), turn) filter (turn % 2 = 1) as region, arg_max('n' || cast(turn as varchar), turn) filter (turn % 3 <> 0) as notes,
         arg_max('lakes,' || cast(turn as varchar), turn) filter (turn % 4 = 1) as scenery, arg_max(turn % 5 = 0, turn) as ready from conversations group by 1""",
)
def str1(spark, sf):
    folded = folds.fold_preferences(blocks(spark, sf), ["region", "notes", "sceneryPreferences"])
    return folded.select("conv_id", "region", "notes", F.array_join("sceneryPreferences", ",").alias("scenery"), "ready")


@query("fn25", "select conv_id, turn, case when text = '' or turn % 3 = 0 then role else text end as merged from conversations")
def fn25(spark, sf):
    new = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", trip.keep_filled(F.col("role"), new).alias("merged"))


def log(spark, sf):
    return view(spark, sf, "log").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


_LIMITED = " union all ".join(
    f"select '{kind}' as kind, time_bucket(interval '{minutes} minutes', ts) as start, ip, count(*) as requests, count(*) > {most} as over from log group by 2, 3"
    for kind, (minutes, most) in traffic.LIMITS.items()
)


@query("str3", _LIMITED)
def str3(spark, sf):
    return _plain(traffic.limited(log(spark, sf)), "start").select("kind", "start", "ip", "requests", "over")


_KINDS = ", ".join(f"('{k}', interval '{m} minutes', {n})" for k, (m, n) in traffic.LIMITS.items())


@query(
    "str3_first",
    f"""with recursive kinds as (select * from (values {_KINDS}) as k(kind, width, most)),
        opened(kind, width, most, ip, start) as (
          select kind, width, most, ip, min(ts) from log, kinds group by 1, 2, 3, 4
          union all
          select o.kind, o.width, o.most, o.ip, min(l.ts) from opened o join log l on l.ip = o.ip and l.ts >= o.start + o.width group by o.kind, o.width, o.most, o.ip, o.start)
        select o.kind, o.start, o.ip, count(*) as requests, count(*) > any_value(o.most) as over
        from opened o join log l on l.ip = o.ip and l.ts >= o.start and l.ts < o.start + o.width group by o.kind, o.start, o.ip""",
)
def str3_first(spark, sf):
    """Request windows that open with the first request of an address."""
    return _plain(windows.over_limit(windows.first_windows(windows.keyed_requests(log(spark, sf)))), "start")


@query("str4", f"select date_trunc('hour', ts) as start, path, count(*) as requests, count(*) filter (status >= 500) as errors, {r3('avg(ms)')} as mean_ms, max(ms) as max_ms from log group by 1, 2")
def str4(spark, sf):
    m = _plain(traffic.log_metrics(log(spark, sf)), "start")
    return m.withColumn("mean_ms", geo.round_to(F.col("mean_ms"), 3))


@query("str5", "select ip as job_id, arg_max(path, ts) as status, max(ts) as ts, count(*) as updates from log group by 1")
def str5(spark, sf):
    jobs = log(spark, sf).select(F.col("ip").alias("job_id"), "ts", F.col("path").alias("status"))
    return _plain(folds.latest_jobs(jobs), "ts")


@query(
    "str5_live",
    f"""select ip || '-' || strftime(ts, '%d%H') as job_id, arg_max(path, ts) as status, min(ts) as created_at from log
        where ts <= timestamp '{TODAY}' group by 1 having min(ts) >= timestamp '{TODAY}' - interval '60 minutes'""",
)
def str5_live(spark, sf):
    """What has not expired at the start of today; a job here is an address within an hour."""
    now = F.lit(TODAY).cast("timestamp")
    job = F.concat("ip", F.lit("-"), F.date_format("ts", "ddHH"))
    jobs = log(spark, sf).filter(F.col("ts") <= now).select(job.alias("job_id"), "ts", F.col("path").alias("status"))
    return _plain(folds.live_jobs(jobs, now), "created_at")


@query(
    "str5_lives",
    """with recursive opened(ip, start) as (
          select ip, min(ts) from log group by 1
          union all
          select o.ip, min(l.ts) from opened o join log l on l.ip = o.ip and l.ts >= o.start + interval '60 minutes' group by o.ip, o.start)
        select o.ip as job_id, o.start as created_at, count(*) as updates, arg_max(l.path, (l.ts, l.path)) as status
        from opened o join log l on l.ip = o.ip and l.ts >= o.start and l.ts < o.start + interval '60 minutes' group by 1, 2""",
)
def str5_lives(spark, sf):
    """Every life of a job: it is made by its first update and dropped after an hour."""
    updates = log(spark, sf).select(F.col("ip").alias("job_id"), "ts", F.col("path").alias("status"))
    lives = windows.first_windows(windows.keyed_jobs(updates))
    return _plain(lives.select(F.col("key").alias("job_id"), F.col("start").alias("created_at"), F.col("rows").alias("updates"), F.col("last").alias("status")), "created_at")


# --- documents -------------------------------------------------------------


def extract_docs(spark, sf):
    """One extract document per region."""
    rows = F.collect_list(F.struct("type", "id", "lat", "lon", "nodes", "tags"))
    return elements(spark, sf).groupBy("region_id").agg(F.to_json(F.struct(rows.alias("elements"))).alias("doc"))


@query(
    "src1",
    """select 'node' as type, node_id as id, lat, lon, case when kind = 'trailhead' then 'trailhead' end as highway, 0 as members from nodes
       union all select 'node', 1000000000 + feature_id, lat, lon, null, 0 from features where class not in ('lake', 'stream')
       union all select 'node', 2000000000 + feature_id * 10 + pos, lat, lon, null, 0 from water_vertices
       union all select 'way', w.way_id, null, null, case w.way_id % 4 when 1 then 'footway' when 2 then null else 'path' end, n from ways w join (
         select way_id, cast(count(*) as int) as n from way_nodes group by 1) c on c.way_id = w.way_id
       union all select 'way', 3000000000 + feature_id, null, null, null, 5 from features where class in ('lake', 'stream')""",
)
def src1(spark, sf):
    rows = documents.elements(extract_docs(spark, sf))
    return rows.select(
        "type", "id", "lat", "lon", F.col("tags")["highway"].alias("highway"), F.coalesce(F.size("nodes"), F.lit(0)).alias("members")
    ).withColumn("members", F.greatest("members", F.lit(0)))


@query("src3", "select n_name as region_id, 'Region ' || n_name as name, cast(n_nationkey as double) as min_lat from nation")
def src3(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("double")
    docs = n.select(
        F.concat(F.lit("Region "), F.col("n_name")).alias("name"),
        F.struct(k.alias("minLat"), k.alias("minLon"), (k + 1).alias("maxLat"), (k + 1).alias("maxLon")).alias("bbox"),
        F.col("n_name").alias("file"),
    )
    root = Stages(spark).root + "/regions"
    docs.write.partitionBy("file").json(root)
    return (
        spark.read.schema(schemas.REGION + ", file string").json(root)
        .select(F.col("file").alias("region_id"), "name", F.col("bbox.minLat").alias("min_lat"))
    )


@query("src4", "select cast(region_id as varchar) as region_id, permit_required, permit_name, permit_id, is_lottery, case when is_lottery then '03-01' end as lottery_open from registry")
def src4(spark, sf):
    r = view(spark, sf, "registry")
    entry = F.struct(
        F.col("permit_required").alias("permitRequired"), F.col("permit_name").alias("permitName"), F.col("permit_id").alias("permitId"),
        F.col("is_lottery").alias("isLottery"), F.when(F.col("is_lottery"), F.struct(F.lit("03-01").alias("open"), F.lit("03-31").alias("close"))).alias("lotteryWindow"),
    )
    one = F.create_map(F.col("region_id").cast("string"), entry)
    docs = r.select(F.to_json(F.struct(one.alias("regions"))).alias("doc"))
    return documents.registry(docs).select("region_id", "permit_required", "permit_name", "permit_id", "is_lottery", "lottery_open")


@query("src5", "select node_id, elev_m from elevation")
def src5(spark, sf):
    e = view(spark, sf, "elevation")
    entries_ = F.map_from_entries(F.collect_list(F.struct(F.col("node_id").cast("string"), "elev_m")))
    docs = e.groupBy(F.floor(F.col("node_id") / 100).alias("r")).agg(F.to_json(entries_).alias("doc"))
    return documents.elevations(docs)


@query("src6", "select node_id, elev_m from elevation")
def src6(spark, sf):
    e = view(spark, sf, "elevation")
    rows = F.array_sort(F.collect_list(F.struct("node_id", "elev_m")))
    batch = e.groupBy(F.floor(F.col("node_id") / 100).alias("r")).agg(rows.alias("rows"))
    docs = batch.select(
        F.transform("rows", lambda r: r["node_id"]).alias("ids"),
        F.to_json(F.struct(F.transform("rows", lambda r: F.struct(r["elev_m"].alias("elevation"))).alias("results"))).alias("doc"),
    )
    return documents.lookup_answers(docs)


@query("src7", "select request_id as cluster_id, seg_idx, trail_name, length_mi from legs")
def src7(spark, sf):
    """Clusters written as documents and read with the cluster schema."""
    seg = F.struct(F.col("trail_name").alias("trailName"), F.col("length_mi").alias("lengthMi"), F.col("gain_ft").cast("int").alias("gainFt"))
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", seg.alias("s"))))
    docs = view(spark, sf, "legs").groupBy("request_id").agg(F.transform(rows, lambda r: r["s"]).alias("segments")).select(
        F.col("request_id").cast("string").alias("start"), "segments"
    )
    root = Stages(spark).root + "/clusters"
    docs.write.json(root)
    return files.read_clusters(spark, root, lines=True).select(
        F.col("start").cast("long").alias("cluster_id"), F.posexplode("segments").alias("seg_idx", "s")
    ).select("cluster_id", "seg_idx", F.col("s.trailName").alias("trail_name"), F.col("s.lengthMi").alias("length_mi"))


@query("src8", "select cast(pref_id as varchar) as notes, days, miles_per_day, tolerance, scenery_text as scenery from prefs")
def src8(spark, sf):
    p = view(spark, sf, "prefs").select(
        F.col("pref_id").cast("string").alias("notes"), F.col("days").alias("daysTarget"), F.col("miles_per_day").alias("milesPerDayTarget"),
        F.col("tolerance").alias("elevationTolerance"), F.split("scenery_text", ",").alias("sceneryPreferences"),
    )
    root = Stages(spark).root + "/prefs"
    p.write.json(root)
    return files.read_preferences(spark, root, lines=True).select(
        "notes", F.col("daysTarget").alias("days"), F.col("milesPerDayTarget").alias("miles_per_day"), F.col("elevationTolerance").alias("tolerance"),
        F.array_join("sceneryPreferences", ",").alias("scenery"),
    )


def replies(spark, sf):
    """One reply per order: plain JSON, JSON inside prose, or no JSON."""
    e = entries(spark, sf)
    days = F.array_sort(F.collect_list(F.struct("day", F.col("segment_ids").alias("segmentIds"), F.lit("on – we go").alias("note"))))
    routes = e.groupBy("request_id").agg(days.alias("itinerary")).select(
        "request_id",
        F.to_json(F.array(F.struct(F.lit("A — B").alias("routeName"), F.lit("main").alias("archetype"), "itinerary", F.array(F.lit("p")).alias("pros")))).alias("doc"),
    )
    k = F.col("request_id") % 3
    said = F.when(k == 0, F.col("doc")).when(k == 1, F.concat(F.lit("Here [it] is:\n"), F.col("doc"), F.lit("\nEnjoy {now}."))).otherwise("no routes found")
    return routes.select("request_id", F.lit(1).alias("attempt"), said.alias("said"))


@query("src9", "select request_id, cast(1 + floor(seg_idx / 2) as int) as day, count(*) + 1 as ids from legs where request_id % 3 < 2 group by 1, 2")
def src9(spark, sf):
    parsed = replies(spark, sf).select("request_id", documents.reply_array(F.col("said")).alias("reply")).filter("reply is not null")
    return parsed.select("request_id", F.explode(F.col("reply")[0]["itinerary"]).alias("d")).select(
        "request_id", F.col("d.day").alias("day"), F.size("d.segmentIds").cast("long").alias("ids")
    )


@query(
    "src11",
    """with d as (select user_id, cast(ts as date) as date, max(value) as high_f, cast(count(*) as int) as code from events group by 1, 2),
       n as (select *, row_number() over (partition by user_id order by date) - 1 as k from d)
       select user_id, cast(k as int) as day_no, cast(date as varchar) as date, high_f, code from n where k < 1 + user_id % 9""",
)
def src11(spark, sf):
    ev = table(spark, sf, "events")
    daily = ev.groupBy("user_id", F.to_date("ts").cast("string").alias("time")).agg(F.max("value").alias("hi"), F.count(F.lit(1)).cast("int").alias("code"))
    rows = F.array_sort(F.collect_list(F.struct("time", "hi", "code")))
    docs = daily.groupBy("user_id").agg(rows.alias("r")).select(
        "user_id", (F.col("user_id") % 9 + 1).alias("days"),
        F.to_json(F.struct(F.struct(
            F.transform("r", lambda x: x["time"]).alias("time"), F.transform("r", lambda x: x["hi"]).alias("temperature_2m_max"), F.transform("r", lambda x: x["code"]).alias("weathercode"),
        ).alias("daily"))).alias("doc"),
    )
    return documents.forecast_days(docs, ["user_id"], "days").select("user_id", "day_no", "date", "high_f", "code")


@query("src12", "select permit_id, date, max(status) as status from slots group by 1, 2")
def src12(spark, sf):
    s = view(spark, sf, "slots").groupBy("permit_id", "date").agg(F.max("status").alias("status"))
    slot = F.when(F.day("date") % 2 == 0, F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z"))).otherwise(F.col("date").cast("string"))
    one = s.groupBy("permit_id").agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("k"), "status"))).alias("m"))
    wrapped = F.substring("permit_id", 2, 3).cast("int") % 2 == 0
    docs = one.select("permit_id", F.when(wrapped, F.to_json(F.struct(F.col("m").alias("payload")))).otherwise(F.to_json("m")).alias("doc"))
    return documents.availability(docs).select("permit_id", "date", "status")


@query("src13", "select id, email, cast(region_id as varchar) as region_id, start_date from alerts")
def src13(spark, sf):
    root = Stages(spark).root + "/alerts"
    rows = alert_rows(spark, sf).withColumn("region_id", F.col("region_id").cast("string"))
    files.write_alerts(rows.limit(0), root, 0)
    files.write_alerts(rows, root, 1)
    return files.read_alerts(spark, root).select("id", "email", "region_id", "start_date")


@query("snk4", "select id, email, cast(region_id as varchar) as region_id, start_date from alerts where email <> 'u3@example.org'")
def snk4(spark, sf):
    root = Stages(spark).root + "/alerts"
    rows = alert_rows(spark, sf).withColumn("region_id", F.col("region_id").cast("string"))
    files.write_alerts(rows, root, 1)
    gone = rows.filter("email = 'u3@example.org'")
    files.write_alerts(trips.remove_alerts(files.read_alerts(spark, root), gone), root, 2)
    return files.read_alerts(spark, root).select("id", "email", "region_id", "start_date")


@query("snk1", "select region_id, node_id, lat, lon from nodes")
def snk1(spark, sf):
    root = Stages(spark).root + "/graph"
    files.write_graph(
        view(spark, sf, "nodes").withColumn("region", F.col("region_id") % 4).withColumnsRenamed({"region_id": "rid", "region": "region_id"}),
        raw_segments(spark, sf).withColumn("region_id", F.col("region_id") % 4),
        view(spark, sf, "trailheads").withColumn("region_id", F.col("region_id") % 4), root,
    )
    return spark.read.parquet(f"{root}/nodes").select(F.col("rid").alias("region_id"), "node_id", "lat", "lon")


@query(
    "snk1_graph",
    f"""with {SEGMENTS} select 'node' as kind, region_id, node_id as id, 0 as part, lat as lat, cast(null as bigint) as head from nodes
        union all select 'segment', region_id, way_id, seg_id, null, start_node from segment
        union all select 'trailhead', region_id, node_id, 0, null, null from trailheads""",
)
def snk1_graph(spark, sf):
    """All three tables of the graph sink, read back."""
    root = Stages(spark).root + "/graph"
    wn, nodes = network(spark, sf)
    files.write_graph(nodes, raw_segments(spark, sf, wn, nodes), view(spark, sf, "trailheads", nodes=nodes), root)
    none = F.lit(None)
    back = {name: spark.read.parquet(f"{root}/{name}") for name in ("nodes", "segments", "trailheads")}
    rows = [
        (back["nodes"], "node", "node_id", F.lit(0), F.col("lat"), none),
        (back["segments"], "segment", "way_id", F.col("seg_id"), none, F.col("start_node")),
        (back["trailheads"], "trailhead", "node_id", F.lit(0), none, none),
    ]
    one, two, three = (
        df.select(
            F.lit(kind).alias("kind"), F.col("region_id").cast("long").alias("region_id"), F.col(key).cast("long").alias("id"), part.cast("long").alias("part"),
            lat.cast("double").alias("lat"), head.cast("long").alias("head"),
        )
        for df, kind, key, part, lat, head in rows
    )
    return one.unionByName(two).unionByName(three)


@query("snk2", "select route_id, miles, center_lat from routes")
def snk2(spark, sf):
    root = Stages(spark).root + "/clusters"
    files.write_clusters(view(spark, sf, "routes"), root, "json")
    return spark.read.schema("route_id bigint, miles double, center_lat double").json(root)


@query("snk3", f"with {ALL_RULES} select request_id, \"check\" from v")
def snk3(spark, sf):
    root = Stages(spark).root + "/out"
    legs, stages = kept(spark, sf, "legs"), Stages(spark)
    told = stages.cut(entries(spark, sf, legs))
    days = it.day_totals(told, it.day_segments(told, segments(spark, sf, legs), ["request_id", "route"]), ["request_id", "route"])
    files.write_itineraries(days, violations(spark, sf, legs), root)
    return spark.read.schema("request_id bigint, check string").json(f"{root}/violations")


@query(
    "snk5",
    """select way_id as request_id, replace(lower('way ' || way_id || '!'), ' ', '-') as file_name, count(*) as points from way_nodes group by 1""",
)
def snk5(spark, sf):
    """Track documents of all ways, counted by their point lines."""
    g = geometry(spark, sf).withColumn("route_name", F.concat(F.lit("Way "), F.col("request_id").cast("string"), F.lit("!")))
    here = F.when(F.size("coords") > 0, F.slice("coords", -1, 1))
    days = g.withColumn("coords", here).withColumn("entry", F.col("pos"))
    docs = it.track_documents(days, ["request_id"])
    return docs.select(
        "request_id", F.regexp_replace("file_name", "-[.]gpx$", "!").alias("file_name"),
        F.size(F.regexp_extract_all("document", F.lit("<trkpt "), F.lit(0))).cast("long").alias("points"),
    )
