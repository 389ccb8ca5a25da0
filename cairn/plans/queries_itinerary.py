"""Queries over requests, days and their texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cairn.functions import geo, hiking, text
from cairn.operators import itinerary as it, quality as q
from cairn.operators.ordering import by_key
from cairn.plans.queries_network import round3
from cairn.plans.registry import half, query, r1, r3
from cairn.plans.views import kept, table, view
from cairn.session import Stages
from cairn.sources import documents

KEY = ["request_id", "route"]
CATS = it.CATEGORIES


def main():
    """All routes of these views carry one label."""
    return F.lit("main").alias("route")


def segments(spark, sf, legs=None):
    """Line items as request segments with six name arrays."""
    none = F.array().cast("array<string>")
    return (legs or view(spark, sf, "legs")).select(
        "request_id", main(), "seg_idx", "trail_name", "length_mi", "gain_ft", "loss_ft",
        *[F.when(F.col("category") == c, F.array("feature")).otherwise(none).alias(c) for c in CATS],
    )


def entries(spark, sf, legs=None):
    """Two segments a day, plus an index that does not exist."""
    day = (F.floor(F.col("seg_idx") / 2) + 1).cast("int")
    return (
        (legs or view(spark, sf, "legs"))
        .groupBy("request_id", day.alias("day"))
        .agg(F.concat(F.array_sort(F.collect_list("seg_idx")), F.array(F.lit(99))).alias("segment_ids"))
        .select("request_id", main(), F.col("day").alias("entry"), "day", "segment_ids", F.lit("").alias("note"))
    )


@query("join18", "select request_id, cast(1 + floor(seg_idx / 2) as int) as entry, seg_idx, trail_name from legs")
def join18(spark, sf):
    return it.day_segments(entries(spark, sf), segments(spark, sf), KEY).select("request_id", "entry", "seg_idx", "trail_name")


def _ordered_sql(value: str, group: str, flt: str = "true") -> str:
    """Distinct values of a group in order of first appearance."""
    return (
        f"select {group}, string_agg(v, ',' order by p) as names from ("
        f"select {group}, {value} as v, min(seg_idx) as p from d where {flt} group by {group}, {value}) x group by {group}"
    )


@query(
    "agg15",
    f"""
    with d as (select *, cast(1 + floor(seg_idx / 2) as int) as day from legs),
    t as ({_ordered_sql("trail_name", "request_id, day")}), f as ({_ordered_sql("category || ':' || feature", "request_id, day")}),
    s as (select request_id, day, {r1("sum(length_mi)")} as miles, cast(sum(gain_ft) as bigint) as gain_ft, cast(sum(loss_ft) as bigint) as loss_ft from d group by 1, 2),
    n as (select request_id, day, count(distinct category || ':' || feature) as features from d group by 1, 2)
    select s.*, t.names as trails, n.features from s join t on s.request_id = t.request_id and s.day = t.day join n on s.request_id = n.request_id and s.day = n.day""",
)
def agg15(spark, sf):
    days = it.day_totals(entries(spark, sf), it.day_segments(entries(spark, sf), segments(spark, sf), KEY), KEY)
    return days.select(
        "request_id", "day", "miles", "gain_ft", "loss_ft", F.array_join("trail_names", ",").alias("trails"),
        sum((F.size(c) for c in CATS), start=F.lit(0)).cast("long").alias("features"),
    )


@query(
    "agg16",
    f"""select request_id, {r1("sum(length_mi)")} as computed_miles, cast(sum(gain_ft) as bigint) as total_gain_ft, cast(sum(loss_ft) as bigint) as total_loss_ft,
          cast(max(1 + floor(seg_idx / 2)) as bigint) as days from legs group by 1""",
)
def agg16(spark, sf):
    days = it.day_totals(entries(spark, sf), it.day_segments(entries(spark, sf), segments(spark, sf), KEY), KEY)
    return it.route_totals(days, KEY).drop("route")


def leg_points(legs):
    """Two points for every segment, from its part and supplier; neighbours often share one."""
    at = lambda n: F.struct((40 + n % 5 / 8).alias("lat"), (-120 - n % 3 / 4).alias("lon"))
    return legs.select(
        "request_id", F.lit("main").alias("archetype"), "seg_idx", F.array(at(F.col("l_partkey")), at(F.col("l_suppkey"))).alias("coords")
    )


def replied_routes(spark, sf, legs=None):
    """One reply an order, read back from its text: the asked route, and for every ninth order one that nobody asked for."""
    days = F.transform(
        F.array_sort(F.collect_list(F.struct("day", F.col("segment_ids").alias("segmentIds")))),
        lambda d: F.struct(d["day"].alias("day"), d["segmentIds"].alias("segmentIds"), F.lit("on – we go").alias("note")),
    )
    route = lambda kind, trip: F.struct(
        F.concat(F.lit("Way — "), F.col("request_id").cast("string")).alias("routeName"), F.lit(kind).alias("archetype"), trip.alias("itinerary")
    )
    by_order = entries(spark, sf, legs).groupBy("request_id").agg(days.alias("itinerary"))
    main_route = route("main", F.col("itinerary"))
    both = F.when(F.col("request_id") % 9 == 0, F.array(main_route, route("other", F.slice("itinerary", 1, 0)))).otherwise(F.array(main_route))
    docs = by_order.select("request_id", F.concat(F.lit("Here:\n"), F.to_json(both)).alias("said"))
    return it.reply_routes(docs.select("request_id", F.lit(1).alias("attempt"), documents.reply_array(F.col("said")).alias("reply")))


@query(
    "agg16_routes",
    f"""with p as (select *, 40 + l_partkey % 5 / 8e0 as lat, -120 - l_partkey % 3 / 4e0 as lon from legs),
        t as (select request_id, count(*) as n, {r1("sum(length_mi)")} as computed_miles, cast(sum(gain_ft) as bigint) as total_gain_ft, cast(sum(loss_ft) as bigint) as total_loss_ft,
          cast(max(1 + floor(seg_idx / 2)) as bigint) as days, arg_min(lat, seg_idx) as head_lat, arg_min(lon, seg_idx) as head_lon from p group by 1)
        select t.request_id, 'main' as archetype, 'Way - ' || t.request_id as route_name, true as asked, g.total_miles, computed_miles, t.total_gain_ft, t.total_loss_ft, t.days,
          r.center_lat, r.center_lon, head_lat, head_lon from t join given g on g.request_id = t.request_id join routes r on r.route_id = t.request_id
        union all select request_id, 'other', 'Way - ' || request_id, false, null, 0, 0, 0, 0, null, null, null, null from t where request_id % 9 = 0""",
)
def agg16_routes(spark, sf):
    """Replies as finished routes: totals, centre of the asked route, trailhead from the first day's points."""
    legs = kept(spark, sf, "legs")
    told = Stages(spark).cut(replied_routes(spark, sf, legs))
    days = it.finished_days(told, segments(spark, sf, legs).withColumnRenamed("route", "archetype"), leg_points(legs))
    centre = view(spark, sf, "routes").select(F.col("route_id").alias("request_id"), F.struct(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")).alias("center"))
    asked = Stages(spark).cut(view(spark, sf, "given").join(by_key(centre), "request_id").withColumn("archetype", F.lit("main")))
    return it.finished_routes(told, days, asked).select(
        "request_id", "archetype", "route_name", "asked", "total_miles", "computed_miles", "total_gain_ft", "total_loss_ft", "days",
        F.col("center.lat").alias("center_lat"), F.col("center.lon").alias("center_lon"),
        F.col("trailhead.lat").alias("head_lat"), F.col("trailhead.lon").alias("head_lon"),
    )


@query(
    "win5",
    f"""
    with m as (select *, case when lag(trail_name) over (partition by request_id order by seg_idx) = trail_name then 0 else 1 end as turn from legs),
    g as (select *, sum(turn) over (partition by request_id order by seg_idx) as island from m)
    select request_id, min(seg_idx) as first_idx, max(seg_idx) as last_idx, trail_name, count(*) as parts, {r3("sum(length_mi)")} as miles,
      cast(sum(gain_ft) as bigint) as gain_ft, cast(sum(loss_ft) as bigint) as loss_ft, count(distinct category || feature) as features
    from g group by request_id, island, trail_name""",
)
def win5(spark, sf):
    groups = it.trail_groups(segments(spark, sf), KEY)
    return round3(groups, "miles").select(
        "request_id", "first_idx", "last_idx", "trail_name", "parts", "miles", "gain_ft", "loss_ft",
        sum((F.size(c) for c in CATS), start=F.lit(0)).cast("long").alias("features"),
    )


def geometry(spark, sf):
    """Each step of a way as a segment of two points, so neighbours share one."""
    from pyspark.sql import Window

    along = Window.partitionBy("way_id").orderBy("pos")
    here = F.struct("lat", "lon")
    pts = view(spark, sf, "way_nodes").join(view(spark, sf, "nodes").select("node_id", "lat", "lon"), "node_id")
    return pts.select(
        F.col("way_id").alias("request_id"), main(), F.lit(1).alias("entry"), F.col("pos").alias("seg_idx"), "pos",
        F.filter(F.array(F.lag(here).over(along), here), lambda p: p.isNotNull()).alias("coords"),
    )


@query(
    "win6",
    f"""
    with p as (select way_id, pos, 1 as k, lat, lon from way_nodes w join nodes n on w.node_id = n.node_id
      union all select way_id, pos, 0, lat0, lon0 from (select way_id, pos, lag(lat) over (partition by way_id order by pos) as lat0,
        lag(lon) over (partition by way_id order by pos) as lon0 from way_nodes w join nodes n on w.node_id = n.node_id) b where lat0 is not null),
    m as (select *, lag(lat) over (partition by way_id order by pos, k) as plat, lag(lon) over (partition by way_id order by pos, k) as plon from p)
    select way_id as request_id, count(*) as points, {r3("sum(lat)")} as lats from m where plat is null or plat <> lat or plon <> lon group by 1""",
)
def win6(spark, sf):
    g = geometry(spark, sf)
    coords = it.day_coords(g.select(*KEY, "entry", "pos", "seg_idx"), g.select(*KEY, "seg_idx", "coords"), KEY)
    return coords.select(
        "request_id", F.size("coords").cast("long").alias("points"),
        geo.round_to(F.aggregate("coords", F.lit(0.0), lambda a, c: a + c["lat"]), 3).alias("lats"),
    )


@query(
    "agg14",
    """select request_id, type, min(seg_idx) as first_pos, count(*) as n, string_agg(feature, ', ' order by seg_idx, feature) as names from legs group by 1, 2""",
)
def agg14(spark, sf):
    feats = view(spark, sf, "legs").select("request_id", F.col("seg_idx").alias("pos"), "type", F.col("feature").alias("name"))
    return it.features_by_type(feats, ["request_id"])


@query(
    "fn22",
    """
    with b as (select request_id, type, min(seg_idx) as p, cast(count(*) as varchar) || ' ' || type || 's: ' || string_agg(feature, ', ' order by seg_idx, feature) as t from legs group by 1, 2),
    s as (select request_id, string_agg(t, '; ' order by p) as feature_summary from b group by 1)
    select r.route_id as request_id, printf('%.2fN, %.2fW', center_lat, abs(center_lon)) as center, feature_summary,
      case when m = 0 then '0' else '0-' || cast(m as varchar) end as span
    from routes r join s on s.request_id = r.route_id join (select request_id, max(seg_idx) as m from legs group by 1) x on x.request_id = r.route_id""",
)
def fn22(spark, sf):
    feats = view(spark, sf, "legs").select("request_id", F.col("seg_idx").alias("pos"), "type", F.col("feature").alias("name"))
    summary = it.feature_summary(it.features_by_type(feats, ["request_id"]), ["request_id"])
    last = view(spark, sf, "legs").groupBy("request_id").agg(F.max("seg_idx").alias("m"))
    return (
        view(spark, sf, "routes").withColumnRenamed("route_id", "request_id").join(summary, "request_id").join(last, "request_id")
        .select("request_id", text.geo_center_text(F.col("center_lat"), F.col("center_lon")).alias("center"), "feature_summary",
                text.range_text(F.lit(0), F.col("m")).alias("span"))
    )


def clusters(spark, sf):
    """Orders as clusters with nested segments and features."""
    segs = segments(spark, sf)
    none = F.lit(None).cast("string")
    row = F.struct(
        "seg_idx", "trail_name", "length_mi", "gain_ft", "loss_ft", none.alias("from_junction"), none.alias("to_junction"),
        F.lit(None).cast("struct<lat:double,lon:double>").alias("midpoint"), *CATS,
    )
    nested = segs.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    feats = view(spark, sf, "legs").groupBy("request_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col("feature").alias("name"), F.col("type").alias("type")))).alias("features")
    )
    return (
        view(spark, sf, "routes").withColumnRenamed("route_id", "request_id").join(nested, "request_id").join(feats, "request_id")
        .select(
            F.col("request_id").alias("cluster_id"), F.col("trailhead_count").alias("cluster_size"), "miles",
            F.col("gain_ft").alias("total_gain_ft"), F.col("loss_ft").alias("total_loss_ft"), F.col("trail_count").alias("distinct_trail_count"),
            "feature_count", "ht_ratio", F.col("n_passes").alias("distinct_passes"), F.col("n_lakes").alias("distinct_lakes"),
            "center_lat", "center_lon", F.lit("start").alias("start"), "features", "segments",
        )
    )


def picks(spark, sf):
    """Every order as a pick of its customer's request."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("route_id"), (F.row_number().over(order) - 1).alias("pick_idx")
    )


@query(
    "prj12",
    f"""
    with p as (select o_custkey as request_id, o_orderkey as route_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pick_idx from orders),
    a as (select p.*, r.ht_ratio, r.miles, case when n_passes >= 2 then 'high-passes' when ht_ratio < 0.15e0 then 'remote' when n_lakes >= 8 then 'scenic'
         when trail_count >= 6 then 'explorer' when pick_idx = 0 then 'classic' when pick_idx = 1 then 'scenic' else 'explorer' end as archetype
      from p join routes r on r.route_id = p.route_id),
    b as (select *, count(*) over (partition by request_id, archetype) as same from a)
    select b.request_id, case when same > 1 then archetype || '#' || cast(pick_idx as varchar) else archetype end as route, b.miles as total_miles,
      {half("ht_ratio * 100")} as ht_percent, l.seg_idx, l.trail_name, l.length_mi
    from b join legs l on l.request_id = b.route_id""",
)
def prj12(spark, sf):
    routes = it.request_routes(picks(spark, sf), clusters(spark, sf))
    return routes.select("request_id", "route", "total_miles", "ht_percent", F.explode("segments").alias("s")).select(
        "request_id", "route", "total_miles", "ht_percent", "s.seg_idx", "s.trail_name", "s.length_mi"
    )


@query("fn23")
def fn23(spark, sf):
    """The whole text of every customer's request."""
    from cairn.plans.queries_scoring import prefs

    routes = it.request_routes(picks(spark, sf), clusters(spark, sf))
    k = F.col("request_id")
    wishes = (
        prefs(spark, sf)
        .withColumnRenamed("pref_id", "request_id")
        .withColumns({
            "experience": F.when(k % 3 == 0, "beginner").when(k % 3 == 1, "experienced"),
            "group_type": F.when(k % 2 == 0, "couple").otherwise("friends"),
            "avoid": F.when(k % 4 == 1, F.array(F.lit("snow"), F.lit("fords"))),
            "priorities": F.array(F.element_at(F.array(F.lit("swimming"), F.lit("views")), (k % 2 + 1).cast("int"))),
            "notes": F.when(k % 5 == 0, F.concat(F.lit("request "), k.cast("string"))),
        })
    )
    return it.prompt_documents(wishes, routes, q.BANNED_WORDS)


# --- day figures -----------------------------------------------------------


@query(
    "fn5",
    """with t as (select request_id, day, cast(floor((miles / 2e0 + gain_ft / 2000e0) * 60 + 0.5e0) as bigint) as m from leg_days)
       select request_id, day, case when m % 60 = 0 then cast(m // 60 as varchar) || 'h' else cast(m // 60 as varchar) || 'h ' || cast(m % 60 as varchar) || 'm' end as t from t""",
)
def fn5(spark, sf):
    return view(spark, sf, "leg_days").select("request_id", "day", hiking.hiking_time(F.col("miles"), F.col("gain_ft")).alias("t"))


@query("fn6", "select request_id, day, case when miles + gain_ft / 400e0 < 18 then 'Moderate' when miles + gain_ft / 400e0 < 28 then 'Strenuous' else 'Very Hard' end as level from leg_days")
def fn6(spark, sf):
    return view(spark, sf, "leg_days").select("request_id", "day", hiking.day_difficulty(F.col("miles"), F.col("gain_ft")).alias("level"))


_NAMES = "select request_id, cast(1 + floor(seg_idx / 2) as int) as day, list(distinct feature) filter (category = '{c}') as {c} from legs group by 1, 2"


def day_lists(spark, sf):
    """Days with their note and six sorted name lists."""
    day = (F.floor(F.col("seg_idx") / 2) + 1).cast("int")
    lists = view(spark, sf, "legs").groupBy("request_id", day.alias("day")).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("feature")))).alias(c) for c in CATS],
        F.array_sort(F.collect_set("trail_name")).alias("trails"),
    )
    return view(spark, sf, "notes").join(lists, ["request_id", "day"])


_LISTS = """
    lists as (select request_id, cast(1 + floor(seg_idx / 2) as int) as day,
        list_sort(list(distinct feature) filter (category = 'lakes')) as lakes, list_sort(list(distinct feature) filter (category = 'streams')) as streams,
        list_sort(list(distinct feature) filter (category = 'landmarks')) as landmarks, list_sort(list(distinct feature) filter (category = 'passes')) as passes,
        list_sort(list(distinct feature) filter (category = 'peaks')) as peaks, list_sort(list(distinct trail_name)) as trails from legs group by 1, 2),
    dayrow as (select n.*, lakes, streams, landmarks, passes, peaks, trails from notes n join lists l on n.request_id = l.request_id and n.day = l.day)"""


@query(
    "fn7",
    f"""with {_LISTS} select request_id, day, case when regexp_matches(note, '(?i)limited water|carry water') and miles > 15 then 'Limited'
          when len(lakes) > 0 and len(streams) > 0 then 'Plentiful' when len(lakes) > 0 or len(streams) > 0 then 'Reliable' else 'Check map' end as level from dayrow""",
)
def fn7(spark, sf):
    d = day_lists(spark, sf)
    note = F.when(F.col("miles") > 15, F.col("note")).otherwise(F.regexp_replace("note", "carry water", "walk"))
    return d.select("request_id", "day", hiking.water_report(F.col("lakes"), F.col("streams"), note)["level"].alias("level"))


_CAMP = f"""
    {_LISTS}, c as (select *, regexp_extract(note, '(?i)Camp[^.]*\\.') as sentence from dayrow),
    places as (
      select c.*, list_concat(list_concat(coalesce(lakes, []), coalesce(streams, [])), coalesce(landmarks, [])) as known from c),
    m as (select *, list_filter(known, lambda n: contains(sentence, n))[1] as spot from places),
    camped as (select *, case when spot is null then null when list_contains(coalesce(lakes, []), spot) then 'lake'
        when list_contains(coalesce(streams, []), spot) then 'stream' else 'landmark' end as kind from m where sentence <> '')"""


@query("fn9", f"with {_CAMP} select request_id, day, regexp_replace(regexp_replace(sentence, '(?i)^Camp\\s*', ''), '\\.$', '') as sentence, spot, kind, coalesce(kind in ('lake', 'stream'), false) as water_nearby from camped")
def fn9(spark, sf):
    d = day_lists(spark, sf)
    c = hiking.camp(F.col("note"), F.col("lakes"), F.col("streams"), F.col("landmarks"))
    return d.select("request_id", "day", c.alias("c")).filter("c is not null").select("request_id", "day", "c.*")


@query("fn29", f"with {_CAMP} select request_id, day, case kind when 'lake' then 'Lakeside camp' when 'stream' then 'Streamside camp' else 'Camp' end as label from camped")
def fn29(spark, sf):
    d = day_lists(spark, sf)
    c = hiking.camp(F.col("note"), F.col("lakes"), F.col("streams"), F.col("landmarks"))
    return d.filter(c.isNotNull()).select("request_id", "day", hiking.camp_kind_label(c["kind"]).alias("label"))


@query(
    "fn10",
    f"""
    with {_LISTS}, p as (select request_id, day, miles, list_filter(trails, lambda t: not contains(t, 'unnamed')) as t,
        len(coalesce(lakes, [])) + len(coalesce(peaks, [])) + len(coalesce(passes, [])) + len(coalesce(landmarks, [])) as n from dayrow),
    e as (select *, greatest(len(t), 1) as c, unnest(range(0, len(t))) as i from p)
    select request_id, day, t[i + 1] as trail, {r3("miles / c")} as miles,
      cast(floor(cast(n * (i + 1) as double) / c) - floor(cast(n * i as double) / c) as int) as features from e""",
)
def fn10(spark, sf):
    d = day_lists(spark, sf)
    shares = hiking.trail_shares(F.col("trails"), F.col("miles"), F.col("lakes"), F.col("peaks"), F.col("passes"), F.col("landmarks"))
    return d.select("request_id", "day", F.explode(shares).alias("s")).select(
        "request_id", "day", "s.trail", geo.round_to(F.col("s.miles"), 3).alias("miles"), F.size("s.features").alias("features")
    )


@query(
    "fn11",
    f"""
    with {_LISTS}
    select request_id, day, 'Many miles' as title from dayrow where miles >= 15
    union all select request_id, day, 'Much climbing' from dayrow where gain_ft >= 3500
    union all select request_id, day, 'Plan water' from dayrow where contains(note, 'carry water')
    union all select request_id, day, passes[1] || ': high ground' from dayrow where len(passes) > 0
    union all select request_id, day, 'Shared long trail' from dayrow where list_contains(trails, 'John Muir Trail') or list_contains(trails, 'Pacific Crest Trail')
    union all select request_id, day, 'Bears about' from dayrow where regexp_matches(note, '(?i)bear|grizzly')""",
)
def fn11(spark, sf):
    d = day_lists(spark, sf)
    calls = hiking.callouts(F.col("note"), F.col("miles"), F.col("gain_ft"), F.col("passes"), F.col("trails"))
    return d.select("request_id", "day", F.explode(calls).alias("c")).select("request_id", "day", "c.title")


@query("fn13", "select doc_id, replace(replace(text, 'ß', '-'), 'é', '-') as text from documents")
def fn13(spark, sf):
    """Dashes are put in where two other letters stand, then made plain again."""
    dashed = F.translate("text", "ßé", "–—")
    return table(spark, sf, "documents").select("doc_id", text.plain_dashes(dashed).alias("text"))


# --- grounding rules -------------------------------------------------------


def told_days(spark, sf, legs=None, once=False):
    """Days as they were written, as a table; not written out where they are read ``once`` and then but for a part."""
    legs = kept(spark, sf, "legs") if legs is None else legs
    day = (F.floor(F.col("seg_idx") / 2) + 1).cast("int")
    shifted = F.col("seg_idx") + F.when((F.col("request_id") + F.col("seg_idx")) % 10 == 0, 1).otherwise(0)
    lists = legs.groupBy("request_id", day.alias("day")).agg(
        F.collect_set("told_trail").alias("trail_names"), F.collect_list(shifted).alias("segment_ids")
    )
    days = view(spark, sf, "notes", legs=legs).join(lists, ["request_id", "day"]).select("*", main(), F.col("day").alias("entry"))
    return days if once else Stages(spark).cut(days)


def given(spark, sf, **at_hand):
    return view(spark, sf, "given", **at_hand).select("*", main())


def told_routes(spark, sf):
    return given(spark, sf).withColumn("total_miles", F.col("told_miles"))


def input_segments(spark, sf, legs=None):
    return (legs or view(spark, sf, "legs")).select("request_id", main(), "seg_idx", "trail_name")


def corpus(spark, sf, legs=None):
    legs = kept(spark, sf, "legs") if legs is None else legs
    feats = legs.select("request_id", main(), F.col("feature").alias("name"))
    trails = legs.select("request_id", main(), "trail_name")
    return Stages(spark).cut(q.names_of(feats, trails))


def allowed(spark, sf, legs):
    return view(spark, sf, "given", legs=legs).select("request_id", F.lit("Heron Ridge").alias("name"))


SHORT = ["request_id", "day", "check"]
_V = "'{check}' as \"check\""


@query("q1", "select o_orderkey as request_id, 'cluster-exists' as \"check\" from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def q1(spark, sf):
    routes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), main())
    return q.unknown_route(routes, given(spark, sf)).select("request_id", "check")


@query("join19", "select o_orderkey as request_id, g.total_miles from orders left join given g on g.request_id = o_orderkey")
def join19(spark, sf):
    routes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), main())
    return routes.join(given(spark, sf), KEY, "left").select("request_id", "total_miles")


@query("q2", "select way_id as request_id, 'route-name' as \"check\" from ways where name is null")
def q2(spark, sf):
    routes = view(spark, sf, "ways").select(F.col("way_id").alias("request_id"), main(), F.coalesce("name", F.lit("undefined")).alias("route_name"))
    return q.missing_name(routes).select("request_id", "check")


@query(
    "q3",
    """select distinct request_id, cast(1 + floor(seg_idx / 2) as int) as day, 'trail-name' as "check", 'trail not in input: ' || told_trail as msg from legs l
       where told_trail not like '%unnamed%' and not exists (select 1 from legs k where k.request_id = l.request_id and k.trail_name = l.told_trail)""",
)
def q3(spark, sf):
    return q.unknown_trail(told_days(spark, sf), input_segments(spark, sf)).select(*SHORT, "msg")


_CORPUS = "corpus as (select request_id, feature as name from legs union select request_id, trail_name from legs)"


@query(
    "q4",
    f"""
    with {_CORPUS}, raw as (select request_id, day, unnest(regexp_extract_all(note, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+')) as t from notes),
    said as (select request_id, day, regexp_replace(t, '^((Descend|Depart|Climb|Pass|Follow|Cross|End|Head|Hike)\\s+)+', '') as t from raw)
    select s.request_id, s.day, 'feature-hallucination' as "check", 'unknown feature: ' || t as msg from said s where contains(t, ' ') and t <> 'Heron Ridge'
      and not exists (select 1 from corpus c where c.request_id = s.request_id and (contains(c.name, s.t) or contains(s.t, c.name)))""",
)
def q4(spark, sf):
    legs = kept(spark, sf, "legs")
    return q.invented_phrases(told_days(spark, sf, legs, once=True), corpus(spark, sf, legs), allowed(spark, sf, legs)).select(*SHORT, "msg")


_COMMON = ", ".join(f"'{w}'" for w in q.COMMON_WORDS)


@query(
    "q5",
    f"""
    with {_CORPUS}, said as (select request_id, day, unnest(regexp_extract_all(note, '\\b[A-Z][a-z]{{2,}}\\b')) as t from notes)
    select s.request_id, s.day, 'feature-hallucination-single' as "check", 'unknown proper noun: ' || t as msg from said s
    where t not in ({_COMMON}) and not exists (select 1 from corpus c where c.request_id = s.request_id and contains(c.name, s.t))""".replace("{{2,}}", "{2,}"),
)
def q5(spark, sf):
    legs = kept(spark, sf, "legs")
    return q.invented_words(told_days(spark, sf, legs, once=True), corpus(spark, sf, legs), allowed(spark, sf, legs)).select(*SHORT, "msg")


@query("set5", f"with {_CORPUS} select request_id, name from corpus")
def set5(spark, sf):
    return corpus(spark, sf).select("request_id", "name")


_Q6 = "select g.request_id, 'mile-sum' as \"check\" from given g join (select request_id, sum(miles) as m from leg_days group by 1) d on d.request_id = g.request_id where abs(m - told_miles) > 0.3e0"
_Q9 = "select g.request_id, 'day-count' as \"check\" from given g join (select request_id, max(day) as d from leg_days group by 1) x on x.request_id = g.request_id where d <> days"
_Q10 = "select d.request_id, day, 'day-balance' as \"check\" from leg_days d join given g on g.request_id = d.request_id where miles < cast(replace(miles_per_day_text, '~', '') as double) * 0.3e0"


@query("q6", _Q6)
def q6(spark, sf):
    return q.mile_sum(told_routes(spark, sf), told_days(spark, sf)).select("request_id", "check")


@query("q7", "select request_id, 'total-miles' as \"check\" from given where told_miles <> total_miles")
def q7(spark, sf):
    return q.total_miles(told_routes(spark, sf), given(spark, sf)).select("request_id", "check")


@query(
    "q8",
    """with s as (select request_id, sum(gain_ft) as g, sum(loss_ft) as l from leg_days group by 1)
       select s.request_id, 'elevation-gain-sum' as "check" from s join given v on v.request_id = s.request_id where abs(g - total_gain_ft) > 50
       union all select s.request_id, 'elevation-loss-sum' from s join given v on v.request_id = s.request_id where abs(l - total_loss_ft) > 50""",
)
def q8(spark, sf):
    return q.climb_sum(told_days(spark, sf), given(spark, sf)).select("request_id", "check")


@query("q9", _Q9)
def q9(spark, sf):
    return q.day_count(told_days(spark, sf), given(spark, sf)).select("request_id", "check")


@query("q10", _Q10)
def q10(spark, sf):
    return q.day_balance(told_days(spark, sf), given(spark, sf)).select(*SHORT)


@query(
    "q11",
    """with c as (select request_id, day, miles, unnest(regexp_extract_all(note, '(?i)\\b(\\d+(?:\\.\\d+)?)\\s*[-–—]?\\s*mi(?:les?)?\\b', 1)) as said from notes)
       select request_id, day, 'note-mile-accuracy' as "check" from c where abs(cast(said as double) - miles) > 0.5e0""",
)
def q11(spark, sf):
    return q.mile_claims(told_days(spark, sf)).select(*SHORT)


@query(
    "q12",
    """with c as (select request_id, day, gain_ft, loss_ft, unnest(regexp_extract_all(note, '(?i)\\b(\\d{1,2},?\\d{3})\\s*[-–—'']?\\s*(?:ft|feet|foot)\\b', 1)) as said from notes)
       select request_id, day, 'note-elev-accuracy' as "check", 'note says ' || cast(replace(said, ',', '') as bigint) || ' ft, day is +' || gain_ft || '/-' || loss_ft as msg
       from c where least(abs(cast(replace(said, ',', '') as bigint) - gain_ft), abs(cast(replace(said, ',', '') as bigint) - loss_ft)) > 100""",
)
def q12(spark, sf):
    return q.feet_claims(told_days(spark, sf)).select(*SHORT, "msg")


def doc_days(spark, sf):
    return view(spark, sf, "docs").select("request_id", main(), F.lit(1).alias("day"), F.lit(1).alias("entry"), F.col("text").alias("note"))


@query(
    "q13",
    """with c as (select request_id, len(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) as w from docs)
       select request_id, 'note-length' as "check", 'note has ' || w || ' words' as msg from c where w < 20 or w > 80""",
)
def q13(spark, sf):
    return q.note_length(doc_days(spark, sf)).select("request_id", "check", "msg")


def doc_points(spark, sf):
    label = F.when(F.col("request_id") % 2 == 0, "pro").otherwise("con")
    return view(spark, sf, "docs").select("request_id", main(), label.alias("label"), "text")


@query(
    "q14",
    """with m as (select request_id, regexp_replace(regexp_replace(text, '([0-9])[.!?]', '\\1', 'g'), '[.!?]([0-9])', '\\1', 'g') as t from docs),
    c as (select request_id, len(list_filter(string_split_regex(t, '[.!?]+'), lambda s: trim(regexp_replace(s, '\\s', ' ', 'g')) <> '')) as n from m)
    select request_id, case request_id % 2 when 0 then 'pro-length' else 'con-length' end as "check", cast(n as varchar) || ' sentences' as msg from c where n > 2""",
)
def q14(spark, sf):
    return q.point_length(doc_points(spark, sf)).select("request_id", "check", "msg")


_DOC_NAMES = "select request_id, case request_id % 4 when 0 then substr(text, 11, 8) when 1 then 'Zz ' || substr(text, 1, 25) when 2 then 'Qqq' else 'Zzz Qqq Www' end as name from docs"


@query(
    "q15",
    f"""
    with names as ({_DOC_NAMES}), w as (select request_id, name, string_split_regex(name, '\\s+') as w from names),
    needles as (select request_id, name from names union
      select request_id, array_to_string(w[i:i + 2], ' ') from (select request_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3) x)
    select d.request_id, case d.request_id % 2 when 0 then 'pro-specificity' else 'con-specificity' end as "check" from docs d
    where not regexp_matches(text, '[0-9]') and not regexp_matches(text, '(?i)\\b({"|".join(q.NUMBER_WORDS)})\\b')
      and not exists (select 1 from needles n where n.request_id = d.request_id and contains(d.text, n.name))""",
)
def q15(spark, sf):
    rest, t = F.col("request_id") % 4, F.col("text")
    name = (
        F.when(rest == 0, F.substring(t, 11, 8)).when(rest == 1, F.concat(F.lit("Zz "), F.substring(t, 1, 25)))
        .when(rest == 2, "Qqq").otherwise("Zzz Qqq Www")
    )
    names = view(spark, sf, "docs").select("request_id", main(), name.alias("name"))
    return q.point_specificity(doc_points(spark, sf), names).select("request_id", "check")


_ASSIGNED = "a as (select request_id, seg_idx + case when (request_id + seg_idx) % 10 = 0 then 1 else 0 end as s from legs)"


@query(
    "q16",
    f"""with {_ASSIGNED} select a.request_id, 'segment-coverage' as "check", cast(count(distinct s) as varchar) || ' of ' || cast(min(n) as varchar) || ' segments assigned' as msg
        from a join (select request_id, count(*) as n from legs group by 1) l on l.request_id = a.request_id group by a.request_id having count(distinct s) <> min(n)""",
)
def q16(spark, sf):
    return q.segment_coverage(told_days(spark, sf), input_segments(spark, sf)).select("request_id", "check", "msg")


@query("q17", f"with {_ASSIGNED} select distinct request_id, 'segment-duplicate' as \"check\" from (select request_id, s from a group by 1, 2 having count(*) > 1) x")
def q17(spark, sf):
    return q.segment_duplicates(told_days(spark, sf)).select("request_id", "check")


@query(
    "set4",
    f"""with {_ASSIGNED}, u as (select request_id, s, count(*) as n from a group by 1, 2)
        select coalesce(u.request_id, l.request_id) as request_id, coalesce(u.s, l.seg_idx) as seg_idx,
          case when u.s is null then 'missing' when l.seg_idx is null then 'unknown' else 'duplicate' end as state
        from u full join legs l on l.request_id = u.request_id and l.seg_idx = u.s where u.s is null or l.seg_idx is null or n > 1""",
)
def set4(spark, sf):
    return q.coverage_difference(told_days(spark, sf), input_segments(spark, sf)).select("request_id", "seg_idx", "state")


WORDS = ["the", "und", "la", "over"]


@query("q18", " union all ".join(f"select request_id, 'banned-word' as \"check\", 'banned word: {w}' as msg from docs where regexp_matches(text, '(?i)\\b{w}\\b')" for w in WORDS))
def q18(spark, sf):
    docs = view(spark, sf, "docs").select("request_id", main(), "text")
    return q.banned_words(docs, WORDS).select("request_id", "check", "msg")


@query(
    "q19",
    """select request_id, 'ascii-hyphen' as "check", 'dash near: ' || substr(text, greatest(strpos(text, 'ß') - 20, 1), strpos(text, 'ß') + 20 - greatest(strpos(text, 'ß') - 20, 1)) as msg
       from docs where contains(text, 'ß')""",
)
def q19(spark, sf):
    docs = view(spark, sf, "docs").select("request_id", main(), "text")
    return q.ascii_hyphens(docs, "ß", 20).select("request_id", "check", "msg")


def written_routes(spark, sf, legs, asked):
    """Routes of all orders as they were written, also those that nobody asked for."""
    miles = asked.select("request_id", F.col("told_miles").alias("total_miles"))
    lists = {"pros": F.array("pro"), "cons": F.array("con"), "gear_tips": F.array("gear")}
    return view(spark, sf, "told", legs=legs).join(miles, "request_id", "left").select("*", main()).withColumns(lists)


def violations(spark, sf, legs) -> DataFrame:
    """All rules over what was written; ``legs`` are read many times."""
    asked = Stages(spark).cut(given(spark, sf, legs=legs))
    routes = Stages(spark).cut(written_routes(spark, sf, legs, asked))
    fine = asked.select("request_id", F.lit("Heron Ridge").alias("name"))
    return q.all_rules(routes, told_days(spark, sf, legs), asked, input_segments(spark, sf, legs), corpus(spark, sf, legs), fine)


_BANNED = ", ".join(f"'{w}'" for w in q.BANNED_WORDS)
ALL_RULES = f"""
    {_CORPUS}, {_ASSIGNED},
    known as (select t.*, g.told_miles, g.total_miles, g.total_gain_ft, g.total_loss_ft, g.days from told t join given g on g.request_id = t.request_id),
    phrase as (select request_id, day, regexp_replace(t, '^((?:{"|".join(q.ACTION_VERBS)})\\s+)+', '') as t from (
      select request_id, day, unnest(regexp_extract_all(note, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+')) as t from notes) x),
    noun as (select request_id, day, unnest(regexp_extract_all(note, '\\b[A-Z][a-z]{{2,}}\\b')) as t from notes),
    miles_said as (select request_id, day, miles, unnest(regexp_extract_all(note, '(?i)\\b(\\d+(?:\\.\\d+)?)\\s*[-–—]?\\s*mi(?:les?)?\\b', 1)) as said from notes),
    feet_said as (select request_id, gain_ft, loss_ft, cast(replace(said, ',', '') as bigint) as said from (
      select *, unnest(regexp_extract_all(note, '(?i)\\b(\\d{{1,2}},?\\d{{3}})\\s*[-–—'']?\\s*(?:ft|feet|foot)\\b', 1)) as said from notes) x),
    walked as (select request_id, sum(miles) as miles, sum(gain_ft) as g, sum(loss_ft) as l, max(day) as last from leg_days group by 1),
    point as (select request_id, 'pro' as label, pro as t from known union all select request_id, 'con', con from known),
    needle as (select request_id, name from corpus union
      select request_id, array_to_string(w[i:i + 2], ' ') from (
        select request_id, w, unnest(range(1, len(w) - 1)) as i from (select request_id, string_split_regex(name, '\\s+') as w from corpus) y where len(w) >= 3) x),
    wording as (select request_id, route_name || ' ' || summary || ' ' || best_for || ' ' || coalesce(n, '') || ' ' || pro || ' ' || con || ' ' || gear as t
      from known k left join (select request_id as r, string_agg(note, ' ') as n from notes group by 1) x on x.r = k.request_id),
    v as (
      select request_id, 'cluster-exists' as "check" from told where request_id not in (select request_id from given)
      union all select request_id, 'route-name' from known where route_name in ('', 'undefined')
      union all select request_id, 'trail-name' from (select distinct request_id, cast(1 + floor(seg_idx / 2) as int) as day, told_trail from legs l
        where told_trail not like '%unnamed%' and not exists (select 1 from legs k where k.request_id = l.request_id and k.trail_name = l.told_trail)) x
      union all select s.request_id, 'feature-hallucination' from phrase s where contains(t, ' ') and t <> 'Heron Ridge'
        and not exists (select 1 from corpus c where c.request_id = s.request_id and (contains(c.name, s.t) or contains(s.t, c.name)))
      union all select s.request_id, 'feature-hallucination-single' from noun s where t not in ({_COMMON})
        and not exists (select 1 from corpus c where c.request_id = s.request_id and contains(c.name, s.t))
      union all select k.request_id, 'mile-sum' from known k join walked w on w.request_id = k.request_id where abs(w.miles - told_miles) > 0.3e0
      union all select request_id, 'total-miles' from known where told_miles <> total_miles
      union all select k.request_id, 'elevation-gain-sum' from known k join walked w on w.request_id = k.request_id where abs(g - total_gain_ft) > 50
      union all select k.request_id, 'elevation-loss-sum' from known k join walked w on w.request_id = k.request_id where abs(l - total_loss_ft) > 50
      union all select k.request_id, 'day-count' from known k join walked w on w.request_id = k.request_id where last <> days
      union all select request_id, "check" from ({_Q10}) x
      union all select request_id, 'note-mile-accuracy' from miles_said where abs(cast(said as double) - miles) > 0.5e0
      union all select request_id, 'note-elev-accuracy' from feet_said where least(abs(said - gain_ft), abs(said - loss_ft)) > 100
      union all select request_id, 'note-length' from notes where len(string_split_regex(note, '[ \\t\\n\\r\\f\\v]+')) not between 20 and 80
      union all select request_id, label || '-length' from (select *, regexp_replace(regexp_replace(t, '([0-9])[.!?]', '\\1', 'g'), '[.!?]([0-9])', '\\1', 'g') as m from point) x
        where len(list_filter(string_split_regex(m, '[.!?]+'), lambda s: trim(regexp_replace(s, '\\s', ' ', 'g')) <> '')) > 2
      union all select p.request_id, label || '-specificity' from point p where not regexp_matches(t, '[0-9]') and not regexp_matches(t, '(?i)\\b({"|".join(q.NUMBER_WORDS)})\\b')
        and not exists (select 1 from needle n where n.request_id = p.request_id and contains(p.t, n.name))
      union all select a.request_id, 'segment-coverage' from a join (select request_id, count(*) as n from legs group by 1) l on l.request_id = a.request_id
        group by a.request_id having count(distinct s) <> min(n)
      union all select distinct request_id, 'segment-duplicate' from (select request_id, s from a group by 1, 2 having count(*) > 1) x
      union all select request_id, 'banned-word' from wording, (select unnest([{_BANNED}]) as w) b where regexp_matches(t, '(?i)\\b' || w || '\\b')
      union all select request_id, 'ascii-hyphen' from wording where regexp_matches(t, '[–—]'))"""


@query("q20", f"with {ALL_RULES} select g.request_id, count(\"check\") = 0 as ok, count(\"check\") as errors from given g left join v on v.request_id = g.request_id group by 1")
def q20(spark, sf):
    legs = kept(spark, sf, "legs")
    return q.results(given(spark, sf, legs=legs), Stages(spark).cut(violations(spark, sf, legs).select("request_id")))


@query(
    "agg21",
    f"""with {ALL_RULES} select request_id, request_id % 3 as attempt, "check", count(*) as errors from v group by 1, 2, 3
        union all select request_id, request_id % 3, null, count(*) from v group by 1, 2""",
)
def agg21(spark, sf):
    legs = kept(spark, sf, "legs")
    return q.attempt_summary(violations(spark, sf, legs).withColumn("attempt", F.col("request_id") % 3))


@query(
    "fn24",
    """with w as (select g.request_id, '- [day-count] last day is ' || cast(d as varchar) || ', wanted ' || cast(days as varchar) as line
         from given g join (select request_id, max(day) as d from leg_days group by 1) x on x.request_id = g.request_id where d <> days)
       select request_id, '1 findings to mend:' || chr(10) || line || chr(10) || 'Send the whole list again as JSON.' as text from w""",
)
def fn24(spark, sf):
    return q.corrections(q.day_count(told_days(spark, sf), given(spark, sf)))
