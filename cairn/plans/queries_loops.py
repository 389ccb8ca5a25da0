"""Queries over walks and loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators import loops, network as net, walks
from cairn.plans import families
from cairn.plans.queries_network import SEGMENTS, elements, kept_segments, raw_segments, round3, series
from cairn.plans.registry import half, query, r1, r3
from cairn.plans.views import network, view

WALKS = (
    SEGMENTS
    + """, d as (select region_id, node_id, count(*) as degree from (
        select region_id, start_node as node_id from segment union all select region_id, end_node from segment) e group by 1, 2),
    anchor as (select d.region_id, d.node_id from d left join trailheads h on h.node_id = d.node_id
      where degree >= 3 or (h.node_id is not null and degree >= 2)),
    move as (select start_node as src, end_node as dst, seg_id * 2 as dir_id, length_mi as mi from segment
      union all select end_node, start_node, seg_id * 2 + 1, length_mi from segment where start_node <> end_node),
    hop as (select src, dst, min(mi) as mi from move where src <> dst group by 1, 2),
    home(anchor, node_id, dist) using key (anchor, node_id) as (
      select node_id, node_id, 0e0 from anchor
      union
      select h.anchor, p.dst, min(h.dist + p.mi) from home h join hop p on p.src = h.node_id
        left join recurring.home o on o.anchor = h.anchor and o.node_id = p.dst
      where h.dist + p.mi <= 22.5e0 and h.dist + p.mi < coalesce(o.dist, 1e9) group by 1, 2),
    walk(region_id, anchor, node_id, miles, path) as (
      select region_id, node_id, node_id, 0e0, cast([] as bigint[]) from anchor
      union all
      select w.region_id, w.anchor, m.dst, w.miles + m.mi, list_append(w.path, m.dir_id)
      from walk w join move m on m.src = w.node_id join home o on o.anchor = w.anchor and o.node_id = m.dst
      where (len(w.path) = 0 or w.node_id <> w.anchor) and len(w.path) < 40 and not list_contains(w.path, m.dir_id)
        and w.miles + m.mi + o.dist <= 45e0 and (m.dst <> w.anchor or w.miles + m.mi >= 25e0)),
    closed as (select region_id, anchor, miles, path from (
      select *, row_number() over (partition by region_id, anchor order by path) as place
      from walk where node_id = anchor and len(path) > 0) c where place <= 2000)"""
)


def all_walks(spark, sf):
    """Closed walks at the full limits: 40 edges, 2000 walks per anchor."""
    wn, nodes = network(spark, sf)
    segs = kept_segments(spark, sf, wn, nodes)
    anchors = walks.start_nodes(segs, nodes.filter("kind = 'trailhead'"))
    return walks.closed_walks(segs, anchors)


@query("gr6", f"with recursive {WALKS} select anchor, {r3('miles')} as miles, array_to_string(path, '.') as path from closed")
def gr6(spark, sf):
    return round3(all_walks(spark, sf), "miles").select("anchor", "miles", F.array_join("path", ".").alias("path"))


@query("top4", f"with recursive {WALKS} select anchor, count(*) as walks, max(len(path)) as longest, array_to_string(max(path), '.') as last from closed group by 1")
def top4(spark, sf):
    """What the cap leaves of each anchor: how many walks, the longest, and the last in search order."""
    return all_walks(spark, sf).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("walks"), F.max(F.size("path")).cast("long").alias("longest"), F.array_join(F.max("path"), ".").alias("last")
    )


@query(
    "gr7",
    f"""
    with recursive {WALKS}, used as (select region_id, anchor, path, miles, unnest(list_transform(path, lambda x: x // 2)) as seg_id from closed),
    counted as (select region_id, anchor, path, miles, seg_id, count(*) as n from used group by all),
    printed as (select region_id, anchor, path, miles, string_agg(cast(seg_id as varchar) || 'x' || cast(n as varchar), '|' order by seg_id) as print
      from counted group by all)
    select region_id, print, {r3("min(miles)")} as miles from printed group by 1, 2""",
)
def gr7(spark, sf):
    return round3(loops.unique_loops(all_walks(spark, sf)), "miles").select("region_id", "print", "miles")


# --- an order as a loop of its line items ---------------------------------


def steps(spark, sf):
    legs = view(spark, sf, "legs")
    named = F.when(F.col("trail_name") != loops.UNNAMED, F.col("trail_name"))
    return legs.select(
        F.col("cust_id").alias("region_id"), F.col("request_id").alias("loop_id"), F.col("seg_idx").alias("step"),
        named.alias("name"), "length_mi", "gain_ft", "loss_ft", (F.col("l_suppkey") % 2 == 0).alias("forward"),
        "feature", "type", "category", "l_partkey",
    )


@query(
    "agg6",
    """select request_id as loop_id, cast(sum(case when l_suppkey % 2 = 0 then gain_ft else loss_ft end) as bigint) as total_gain_ft,
         cast(sum(case when l_suppkey % 2 = 0 then loss_ft else gain_ft end) as bigint) as total_loss_ft from legs group by 1""",
)
def agg6(spark, sf):
    return loops.loop_climb(steps(spark, sf)).drop("region_id")


@query(
    "agg7",
    """select request_id as loop_id, coalesce(string_agg(distinct trail_name, '|' order by trail_name) filter (trail_name <> '(unnamed)'), '') as names,
         count(distinct trail_name) filter (trail_name <> '(unnamed)') as n from legs group by 1""",
)
def agg7(spark, sf):
    return loops.trail_names(steps(spark, sf)).select(
        "loop_id", F.array_join("distinct_trails", "|").alias("names"), F.col("distinct_trail_count").alias("n")
    )


@query(
    "win4",
    """select request_id as loop_id, string_agg(trail_name, ' > ' order by seg_idx) as route from (
         select *, lag(trail_name) over (partition by request_id order by seg_idx) as before from legs) l
       where before is null or before <> trail_name group by 1""",
)
def win4(spark, sf):
    return loops.trail_route(steps(spark, sf)).select("loop_id", F.array_join("trail_route", " > ").alias("route"))


POOL = """
    pool as (select request_id as loop_id, feature as name, type,
        case when category = 'streams' then 'stream:' || feature when category = 'lakes' then 'way:' || cast(l_partkey as varchar)
          else 'node:' || cast(l_partkey as varchar) end as key
      from legs),
    uniq as (select loop_id, key, min(name) as name, min(type) as type from pool group by 1, 2)"""


def pool(spark, sf):
    """Features of the steps through their six arrays, as a segment carries them."""
    s = steps(spark, sf)
    one = F.array(F.struct(F.col("l_partkey").alias("id"), F.col("feature").alias("name"), F.col("type"), F.lit(0.0).alias("dist_mi")))
    arrays = [
        F.when(F.col("category") == c, one) for c in ("peaks", "passes", "springs", "landmarks", "lakes", "streams")
    ]
    return s.select("region_id", "loop_id", F.explode(loops.feature_pool(*arrays)).alias("f")).select("region_id", "loop_id", "f.*")


@query("set2", f"with {POOL} select loop_id, key, count(*) as n from pool group by 1, 2")
def set2(spark, sf):
    return pool(spark, sf).groupBy("loop_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query("agg8", f"with {POOL} select loop_id, string_agg(name || '/' || type, ',' order by name, type) as features, count(*) as n from uniq group by 1")
def agg8(spark, sf):
    feats = loops.loop_features(pool(spark, sf))
    listed = loops.feature_list(feats).select(
        "loop_id", F.array_join(F.transform("features", lambda f: F.concat_ws("/", f["name"], f["type"])), ",").alias("features"),
        F.size("features").cast("long").alias("n"),
    )
    return listed


@query(
    "agg12",
    f"""with {POOL} select loop_id, count(*) as feature_count, count(distinct case when type in ('saddle', 'pass') then name end) as distinct_passes,
          count(distinct case when type in ('lake', 'water', 'reservoir') then name end) as distinct_lakes,
          count(distinct case when type = 'peak' then name end) as distinct_peaks from uniq group by 1""",
)
def agg12(spark, sf):
    return loops.feature_counts(loops.loop_features(pool(spark, sf))).drop("region_id")


@query(
    "agg9",
    f"""select request_id as loop_id, {r3("sum(case when trail_name in ('John Muir Trail', 'Pacific Crest Trail') then l_quantity else 0 end) / sum(l_quantity)")} as ht_ratio
        from legs group by 1""",
)
def agg9(spark, sf):
    return round3(loops.traffic_ratio(steps(spark, sf)), "ht_ratio").drop("region_id")


@query(
    "agg10",
    f"""with j as (select distinct w.way_id, w.node_id, lat, lon from way_nodes w join nodes n on w.node_id = n.node_id)
        select way_id as loop_id, {r3("avg(lat)")} as center_lat, {r3("avg(lon)")} as center_lon from j group by 1""",
)
def agg10(spark, sf):
    ends = view(spark, sf, "way_nodes").select(
        "region_id", F.col("way_id").alias("loop_id"), F.col("node_id").alias("start_node"), F.col("node_id").alias("end_node")
    )
    return round3(loops.centroid(ends, view(spark, sf, "nodes")), "center_lat", "center_lon").drop("region_id")


@query(
    "agg11",
    """with m as (select request_id, trail_name, sum(l_quantity) as q from legs where trail_name <> '(unnamed)' group by 1, 2)
       select request_id as loop_id, arg_min(trail_name, (-q, trail_name)) as top_trail from m group by 1""",
)
def agg11(spark, sf):
    return loops.top_trail(steps(spark, sf)).drop("region_id")


@query(
    "agg13",
    """select region_id, way_id % 3 as loop_id, count(*) as cluster_size, count(distinct coalesce(name, '')) as trailhead_count
       from ways group by 1, 2""",
)
def agg13(spark, sf):
    ways = view(spark, sf, "ways")
    fam = ways.select("region_id", F.col("way_id").alias("loop_id"), (F.col("way_id") % 3).alias("leader_id"))
    starts = ways.select("region_id", F.col("way_id").alias("loop_id"), F.coalesce("name", F.lit("")).alias("start"))
    return loops.family_size(fam, starts)


# --- overlap ---------------------------------------------------------------


def node_sets(spark, sf):
    return view(spark, sf, "way_nodes").groupBy("region_id", F.col("way_id").alias("set_id")).agg(F.collect_set("node_id").alias("items"))


OVERLAP = """
    t as (select distinct region_id, way_id, node_id from way_nodes), n as (select way_id, count(*) as n from t group by 1),
    p as (select a.region_id, a.way_id as a, b.way_id as b, count(*) as shared from t a join t b on a.region_id = b.region_id and a.node_id = b.node_id
        and a.way_id < b.way_id group by 1, 2, 3),
    o as (select p.*, cast(shared as double) / (na.n + nb.n - shared) as overlap from p join n na on na.way_id = a join n nb on nb.way_id = b)"""


@query("join20", f"with {OVERLAP} select region_id, a, b, cast(shared as int) as shared from o where overlap > 0.3e0")
def join20(spark, sf):
    return loops.overlapping_pairs(node_sets(spark, sf), 0.3).select("region_id", "a", "b", "shared")


@query("join20_similar", f"with {OVERLAP} select region_id, a, b, cast(shared as int) as shared from o where overlap > 0.6e0")
def join20_similar(spark, sf):
    return loops.overlapping_pairs(node_sets(spark, sf), loops.SIMILARITY).select("region_id", "a", "b", "shared")


@query("set3", f"""with t as (select distinct way_id, node_id % 100 as k from way_nodes), f as (select way_id, k, case when k < 12 then 1 else 0 end as low from t)
    select way_id, {r3("cast(sum(low) as double) / (12 + count(*) - sum(low))")} as overlap from f group by 1""")
def set3(spark, sf):
    """Overlap of every way with the first twelve nodes of its region."""
    sets = node_sets(spark, sf)
    first = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.col("region_id") * 100 + k)
    return sets.select(F.col("set_id").alias("way_id"), geo.round_to(loops.iou(F.col("items"), first), 3).alias("overlap"))


def _families_sql(threshold: float) -> str:
    """Sets one after the other, largest first, each with the list of the leaders so far."""
    return f"""
    with recursive t as (select distinct region_id, way_id, node_id from way_nodes),
    s as (select region_id, way_id, list(node_id) as items, count(*) as n from t group by 1, 2),
    r as (select *, row_number() over (partition by region_id order by n desc, way_id) as pos from s),
    walk(region_id, pos, leaders, loop_id, leader_id) as (
      select region_id, pos, [struct_pack(w := way_id, i := items)], way_id, way_id from r where pos = 1
      union all
      select region_id, pos, case when hit is null then list_append(leaders, struct_pack(w := way_id, i := items)) else leaders end, way_id, coalesce(hit, way_id) from (
        select r.region_id, r.pos, w.leaders, r.way_id, r.items, list_filter(w.leaders, lambda l:
            cast(len(list_intersect(l.i, r.items)) as double) / (len(l.i) + len(r.items) - len(list_intersect(l.i, r.items))) > {threshold}e0)[1].w as hit
        from walk w join r on r.region_id = w.region_id and r.pos = w.pos + 1) x)
    select region_id, loop_id, leader_id from walk"""


def _ranked(spark, sf):
    return node_sets(spark, sf).select(
        "region_id", F.col("set_id").alias("loop_id"), F.col("items").alias("seg_ids"),
        F.struct((-F.size("items")).alias("a"), F.col("set_id").alias("b")).alias("rank"),
    )


@query("gr8", _families_sql(loops.SIMILARITY))
def gr8(spark, sf):
    return loops.loop_families(_ranked(spark, sf)).select("region_id", "loop_id", "leader_id")


@query("gr8_loose", _families_sql(0.3))
def gr8_loose(spark, sf):
    """At a lower overlap, where families are larger."""
    return loops.loop_families(_ranked(spark, sf), 0.3).select("region_id", "loop_id", "leader_id")


@query(
    "gr9",
    f"""
    with {SEGMENTS}, met as (
      select e.region_id, node_id, name, min(seg_id) as seg_id from (
        select region_id, way_id, seg_id, start_node as node_id from segment union all select region_id, way_id, seg_id, end_node from segment) e
      join ways w on w.way_id = e.way_id where name is not null group by 1, 2, 3),
    shown as (select *, row_number() over (partition by node_id order by seg_id, name) as place from met),
    named as (select node_id, string_agg(name, ' / ' order by place) as names from shown where place <= 3 group by 1),
    spots as (select region_id, start_node as node_id from segment union select region_id, end_node from segment)
    select s.region_id, s.node_id, coalesce(h.name, 'jct (' || names || ')', 'junction ' || cast(s.node_id as varchar)) as label
    from spots s left join named n on n.node_id = s.node_id left join trailheads h on h.node_id = s.node_id""",
)
def gr9(spark, sf):
    return loops.junction_labels(raw_segments(spark, sf), view(spark, sf, "trailheads"))


@query("gr10")
def gr10(spark, sf):
    """Families of all closed walks of every anchor, however many."""
    found = families.clusters_of(elements(spark, sf), view(spark, sf, "elevation"), cap=None)
    return found.select(
        "region_id", "cluster_id", "miles", "total_gain_ft", "total_loss_ft", "feature_count", "distinct_lakes", "distinct_peaks",
        "distinct_passes", geo.round_to(F.col("ht_ratio"), 3).alias("ht_ratio"), "trailhead_count", "cluster_size", "top_trail",
        "distinct_trail_count", "start", F.size("segments").alias("segments"),
    )


# --- samples and lists -----------------------------------------------------


@query(
    "top5",
    """select user_id, pos from (select user_id, pos, count(*) over (partition by user_id) as n from series) s
       where pos % greatest(1, cast(floor(n / 20) as bigint)) = 0 or pos = n - 1""",
)
def top5(spark, sf):
    return loops.sample_rows(series(spark, sf), ["user_id"]).select("user_id", "pos")


@query(
    "top6",
    """select way_id, node_id from (select *, count(*) over (partition by way_id) as n from way_nodes) w where pos = cast(floor(n / 2) as bigint)""",
)
def top6(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda v: v["node_id"])
    ways = view(spark, sf, "way_nodes").groupBy("way_id").agg(ids.alias("ids"))
    return ways.select("way_id", loops.midpoint(F.col("ids")).alias("node_id")).filter("node_id is not null")


@query(
    "top7",
    """with n as (select distinct region_id, name from ways where name is not null),
         r as (select *, row_number() over (partition by region_id order by name) as rank from n)
       select region_id, string_agg(name, ',' order by name) as names from r where rank <= 20 group by 1""",
)
def top7(spark, sf):
    return net.sample_names(view(spark, sf, "ways")).select("region_id", F.array_join("names", ",").alias("names"))


@query(
    "win9",
    """select p_partkey, max(l_orderkey) as last_order, arg_max(l_quantity, (l_orderkey, l_linenumber, l_suppkey)) as last_quantity
       from part join lineitem on l_partkey = p_partkey group by 1""",
)
def win9(spark, sf):
    """Last write wins: the latest line of every part."""
    from cairn.plans.views import table

    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_orderkey").alias("last_order"), F.max_by("l_quantity", order).alias("last_quantity")
    )
