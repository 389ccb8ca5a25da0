"""Queries over the network: classes, junctions, segments, distances, elevation, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import geo
from cairn.operators import components as comp, contraction, distance, elevation as elev, extracts, network as net, walks
from cairn.plans import build
from cairn.plans.registry import half, hav, query, r3
from cairn.plans.views import kept, network, view
from cairn.session import Stages


def round3(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: geo.round_to(F.col(n), 3) for n in names})


# --- elements --------------------------------------------------------------

NODE_TAGS = """
    select region_id, 1000000000 + feature_id as id, name,
      case class when 'peak' then 'peak' when 'spring' then 'spring'
        when 'landmark' then case feature_id % 4 when 0 then 'waterfall' when 1 then 'cliff' end
        when 'pass' then case feature_id % 2 when 0 then 'saddle' end end as natural_tag,
      case when class = 'pass' and feature_id % 2 = 1 then 'yes' end as mountain_pass,
      case when class = 'landmark' and feature_id % 4 = 2 then 'viewpoint' end as tourism,
      case when class = 'landmark' and feature_id % 4 = 3 then 'yes' end as historic,
      case when class = 'peak' and feature_id % 5 = 0 then name || ' Notch' else name end as told_name
    from features where class in ('peak', 'pass', 'spring', 'landmark')"""


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """The elements as a table, written once as an extract would be."""
    wn, nodes = network(spark, sf)
    features = kept(spark, sf, "features")
    heads, water = view(spark, sf, "trailheads", nodes=nodes), view(spark, sf, "water_vertices", features=features)
    return Stages(spark).cut(build.elements(nodes, heads, features, water, view(spark, sf, "ways"), wn))


@query(
    "prj1",
    f"""
    with t as ({NODE_TAGS}), named as (
      select *, coalesce(length(told_name), 0) > 0 as has_name,
        coalesce(regexp_matches(told_name, '(?i)stairway|stairs|gap|notch|chute|steps?(\\s|$)|bench|ledge|shelf|ramp'), false) as odd
      from t), c as (
      select region_id, id, 'peak' as class from named where natural_tag = 'peak' and has_name and not odd
      union all select region_id, id, 'pass' from named where natural_tag = 'saddle' or mountain_pass = 'yes'
      union all select region_id, id, 'spring' from named where natural_tag = 'spring'
      union all select region_id, id, 'landmark' from named where (natural_tag = 'peak' and has_name and odd)
        or natural_tag = 'waterfall' or (natural_tag = 'cliff' and has_name) or tourism = 'viewpoint' or (historic is not null and has_name)
      union all select region_id, node_id, 'trailhead' from trailheads
      union all select region_id, way_id, 'trail' from ways where way_id in (select way_id from way_nodes)
      union all select region_id, 3000000000 + feature_id, class from features where class in ('lake', 'stream'))
    select region_id, id, class from c""",
)
def prj1(spark, sf):
    return net.classify(elements(spark, sf)).select("region_id", "id", "class")


@query(
    "prj2",
    f"""select region_id, id, told_name as name from ({NODE_TAGS}) t where natural_tag = 'peak' and contains(told_name, 'Notch')""",
)
def prj2(spark, sf):
    e = elements(spark, sf)
    return e.filter((F.col("tags")["natural"] == "peak") & net.misnamed_peak(F.col("tags")["name"])).select(
        "region_id", "id", F.col("tags")["name"].alias("name")
    )


@query(
    "prj3",
    """select region_id, way_id as id from ways where way_id in (select way_id from way_nodes)""",
)
def prj3(spark, sf):
    e = elements(spark, sf)
    return e.filter((F.col("type") == "way") & net.is_trail(F.col("tags"))).select("region_id", "id")


@query(
    "prj4",
    f"""select coalesce(natural_tag, case when mountain_pass = 'yes' then 'pass' else 'feature' end) as type, count(*) as n
        from ({NODE_TAGS}) t group by 1""",
)
def prj4(spark, sf):
    e = elements(spark, sf).filter("type = 'node' and id between 1000000000 and 1999999999")
    return e.groupBy(net.feature_type(F.col("tags")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj5",
    """select case when class = 'stream' then case feature_id % 2 when 0 then 'stream' else 'river' end
          when feature_id % 3 = 0 then 'lake' else 'water' end as type, count(*) as n
       from features where class in ('lake', 'stream') group by 1""",
)
def prj5(spark, sf):
    e = elements(spark, sf).filter("type = 'way' and id >= 3000000000")
    return e.groupBy(net.water_type(F.col("tags")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


_EXTRACT = f"""
    with t as ({NODE_TAGS}), w as (
      select distinct n.region_id, n.way_id as id from way_nodes n
      join nodes p on n.region_id = p.region_id and n.node_id = p.node_id join ways y on y.way_id = n.way_id
      join boxes b on b.region_id = n.region_id
      where p.lat between min_lat and max_lat and p.lon between min_lon and max_lon
        and (y.name is not null or y.sac_scale is not null or n.way_id % 4 = 2) and not (n.way_id % 4 = 1 and y.name is null)
      union select distinct v.region_id, 3000000000 + feature_id from water_vertices v join boxes b on b.region_id = v.region_id
      where lat between min_lat and max_lat and lon between min_lon and max_lon),
    k as (
      select t.region_id, t.id from t join features f on t.id = 1000000000 + f.feature_id join boxes b on b.region_id = t.region_id
      where lat between min_lat and max_lat and lon between min_lon and max_lon
        and not (natural_tag in ('peak', 'cliff') and told_name is null and natural_tag is not null)
        and not (historic is not null and told_name is null and natural_tag is null)
      union select n.region_id, n.node_id from trailheads h join nodes n on h.node_id = n.node_id join boxes b on b.region_id = n.region_id
      where lat between min_lat and max_lat and lon between min_lon and max_lon
      union select n.region_id, n.node_id from way_nodes n join w on w.id = n.way_id
      union select v.region_id, 2000000000 + v.feature_id * 10 + v.pos from water_vertices v join w on w.id = 3000000000 + v.feature_id)
    select region_id, id, 'node' as type from k union all select region_id, id, 'way' from w"""


@query("src2", _EXTRACT)
def src2(spark, sf):
    return net.extract(elements(spark, sf), view(spark, sf, "boxes")).select("region_id", "id", "type")


#: The own query of every second region.
_OWN = [
    'way["highway"~"path|footway"]["sac_scale"]',
    'way["waterway"~"stream|river"]',
    'node["natural"="saddle"]',
    'node["natural"~"water.all"]["name"!="none"]',
    'node["highway"="trailhead"]',
]


@query(
    "src2_own",
    f"""with inside as (
          select n.region_id, n.node_id from nodes n join boxes b on b.region_id = n.region_id where lat between min_lat and max_lat and lon between min_lon and max_lon),
        w as (
          select distinct v.region_id, v.way_id as id from way_nodes v join inside i on i.region_id = v.region_id and i.node_id = v.node_id
          where v.way_id % 4 = 0 and v.region_id % 2 = 0
          union select v.region_id, 3000000000 + v.feature_id from water_vertices v join features f on f.feature_id = v.feature_id join boxes b on b.region_id = v.region_id
          where f.class = 'stream' and v.lat between min_lat and max_lat and v.lon between min_lon and max_lon and v.region_id % 2 = 0),
        k as (
          select t.region_id, t.id from ({NODE_TAGS}) t join features f on t.id = 1000000000 + f.feature_id join boxes b on b.region_id = t.region_id
          where natural_tag in ('saddle', 'waterfall') and lat between min_lat and max_lat and lon between min_lon and max_lon and t.region_id % 2 = 0
          union select i.region_id, i.node_id from inside i join trailheads h on h.node_id = i.node_id where i.region_id % 2 = 0
          union select v.region_id, v.node_id from way_nodes v join w on w.id = v.way_id
          union select v.region_id, 2000000000 + v.feature_id * 10 + v.pos from water_vertices v join w on w.id = 3000000000 + v.feature_id)
        select region_id, id, 'node' as type from k union all select region_id, id, 'way' from w
        union all select region_id, id, type from ({_EXTRACT}) x where region_id % 2 = 1""",
)
def src2_own(spark, sf):
    """Extracts by the regions' own queries; every second region has none and takes the default clauses."""
    box = [F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]
    regions = view(spark, sf, "boxes").select(
        "region_id",
        F.struct(*[c.alias(n) for c, n in zip(box, ("minLat", "minLon", "maxLat", "maxLon"))]).alias("bbox"),
        F.when(F.col("region_id") % 2 == 0, extracts.query_of(_OWN, box)).alias("overpassQuery"),
    )
    return extracts.extract_by_query(elements(spark, sf), extracts.own_or_default(regions)).select("region_id", "id", "type")


# --- junctions and segments -----------------------------------------------

JUNCTIONS = """
    select region_id, node_id from (
      select region_id, node_id from way_nodes group by region_id, node_id having count(distinct way_id) >= 2) s
    union select region_id, node_id from trailheads
    union select region_id, node_id from (
      select region_id, node_id, pos, min(pos) over (partition by way_id) as a, max(pos) over (partition by way_id) as b
      from way_nodes) e where pos = a or pos = b"""
PIECES = f"""
    junction as ({JUNCTIONS}),
    m as (
      select w.*, case when j.node_id is not null and pos > 0 and pos < max(pos) over (partition by way_id) then 1 else 0 end as cut,
        max(pos) over (partition by way_id) as last_pos
      from way_nodes w left join junction j on w.region_id = j.region_id and w.node_id = j.node_id),
    s as (
      select *, coalesce(sum(cut) over (partition by way_id order by pos rows between unbounded preceding and 1 preceding), 0) as sub0 from m),
    pieces as (
      select region_id, way_id, cast(sub0 as bigint) as sub, pos, node_id from s where last_pos > 0
      union all select region_id, way_id, cast(sub0 + 1 as bigint), pos, node_id from s where cut = 1)"""
SEGMENTS = f"""
    {PIECES},
    stepped as (
      select p.region_id, way_id, sub, pos, p.node_id,
        lag(lat) over (partition by way_id, sub order by pos) as lat0, lag(lon) over (partition by way_id, sub order by pos) as lon0, lat, lon
      from pieces p join nodes n on p.region_id = n.region_id and p.node_id = n.node_id),
    measured as (
      select region_id, way_id, sub, arg_min(node_id, pos) as start_node, arg_max(node_id, pos) as end_node,
        count(*) as node_count, coalesce(sum({hav("lat0", "lon0", "lat", "lon")}), 0) as miles
      from stepped group by region_id, way_id, sub),
    segment as (
      select region_id, way_id, sub, way_id * 10000 + sub as seg_id, start_node, end_node, node_count, {r3("miles")} as length_mi
      from measured where miles >= 0.001e0)"""


def pieces(spark, sf):
    wn = view(spark, sf, "way_nodes")
    return net.split_ways(wn, net.junctions(wn, view(spark, sf, "trailheads")))


def raw_segments(spark, sf, wn=None, nodes=None, spots=None):
    """Segments without the merging of micro pieces."""
    if wn is None:
        wn, nodes = network(spark, sf)
    if spots is None:
        spots = net.junctions(wn, nodes.filter("kind = 'trailhead'"))
    subs = net.assemble(net.split_ways(net.located(wn, nodes), spots))
    return net.segments_from(subs, view(spark, sf, "ways"))


def kept_segments(spark, sf, wn=None, nodes=None, spots=None):
    """The same, written once where several steps read them."""
    return Stages(spark).cut(raw_segments(spark, sf, wn, nodes, spots))


@query("agg1", "select region_id, node_id, count(distinct way_id) as way_count from way_nodes group by region_id, node_id")
def agg1(spark, sf):
    return net.node_usage(view(spark, sf, "way_nodes"))


@query("set1", JUNCTIONS)
def set1(spark, sf):
    return net.junctions(view(spark, sf, "way_nodes"), view(spark, sf, "trailheads"))


@query("win3", f"with {PIECES} select region_id, way_id, sub, pos, node_id from pieces")
def win3(spark, sf):
    return pieces(spark, sf)


@query(
    "join1",
    """select w.way_id, w.pos, n.lat, n.lon from way_nodes w join nodes n on w.region_id = n.region_id and w.node_id = n.node_id""",
)
def join1(spark, sf):
    return net.located(view(spark, sf, "way_nodes"), view(spark, sf, "nodes")).select("way_id", "pos", "lat", "lon")


@query(
    "agg2",
    f"""
    with p as (
      select w.way_id, lat, lon, lag(lat) over (partition by way_id order by pos) as lat0, lag(lon) over (partition by way_id order by pos) as lon0
      from way_nodes w join nodes n on w.region_id = n.region_id and w.node_id = n.node_id)
    select way_id, {r3("coalesce(sum(" + hav("lat0", "lon0", "lat", "lon") + "), 0)")} as miles from p group by way_id""",
)
def agg2(spark, sf):
    points = net.located(view(spark, sf, "way_nodes"), view(spark, sf, "nodes"))
    return round3(net.polyline_miles(points, ["way_id"]), "miles")


@query(
    "agg3",
    """select way_id, min(lat) as min_lat, max(lat) as max_lat, min(lon) as min_lon, max(lon) as max_lon
       from way_nodes w join nodes n on w.region_id = n.region_id and w.node_id = n.node_id group by way_id""",
)
def agg3(spark, sf):
    return net.bounding_box(net.located(view(spark, sf, "way_nodes"), view(spark, sf, "nodes")), ["way_id"])


@query("prj6", f"with {SEGMENTS} select region_id, way_id, sub, start_node, end_node, node_count, length_mi from segment")
def prj6(spark, sf):
    return raw_segments(spark, sf).select(
        "region_id", "way_id", "sub", "start_node", "end_node", F.col("node_count").cast("long").alias("node_count"), "length_mi"
    )


@query(
    "agg19",
    f"""with {SEGMENTS} select region_id, node_id, count(*) as degree from (
        select region_id, start_node as node_id from segment union all select region_id, end_node from segment) e group by 1, 2""",
)
def agg19(spark, sf):
    return net.degree(raw_segments(spark, sf))


@query(
    "prj7",
    f"""with {SEGMENTS}, d as (
          select region_id, node_id from (select region_id, start_node as node_id from segment union all select region_id, end_node from segment) e
          group by 1, 2 having count(*) = 1)
        select d.region_id, d.node_id from d join nodes n on d.node_id = n.node_id join boxes b on b.region_id = d.region_id
        where least(abs(lat - min_lat), abs(lat - max_lat), abs(lon - min_lon), abs(lon - max_lon)) < 0.005e0""",
)
def prj7(spark, sf):
    return net.boundary_nodes(raw_segments(spark, sf), view(spark, sf, "nodes"), view(spark, sf, "boxes"))


@query(
    "prj16",
    f"""with {SEGMENTS}, d as (
          select region_id, node_id, count(*) as degree from (
            select region_id, start_node as node_id from segment union all select region_id, end_node from segment) e group by 1, 2)
        select d.region_id, d.node_id as anchor from d left join trailheads h on h.node_id = d.node_id
        where degree >= 3 or (h.node_id is not null and degree >= 2)""",
)
def prj16(spark, sf):
    return walks.start_nodes(raw_segments(spark, sf), view(spark, sf, "trailheads"))


@query("gr2")
def gr2(spark, sf):
    wn, nodes = network(spark, sf)
    return round3(build.contracted(spark, view(spark, sf, "ways"), wn, nodes.filter("kind = 'trailhead'"), nodes), "miles").select(
        "region_id", "way_id", "sub", F.array_join("node_ids", ",").alias("nodes"), "miles"
    )


@query("gr1")
def gr1(spark, sf):
    g = build.graph(elements(spark, sf))
    return g.segments.select(
        "region_id", "way_id", "sub", "name", "start_node", "end_node", "length_mi",
        *[F.size(f"nearby_{k}").alias(k) for k in ("peaks", "passes", "springs", "landmarks", "lakes", "streams")],
    )


# --- components ------------------------------------------------------------

EDGES = f"""{SEGMENTS}, edge as (
      select region_id, start_node as a, end_node as b from segment where start_node <> end_node
      union select region_id, end_node, start_node from segment where start_node <> end_node),
    spot as (select region_id, node_id from junction)"""
# regions are small, so the reachable set of every node can be written out in SQL
REACH = EDGES + """, reach(node_id, other) as (
      select node_id, node_id from spot union select r.node_id, e.b from reach r join edge e on r.other = e.a),
    label as (select node_id, min(other) as component from reach group by node_id)"""


@query(
    "agg4",
    f"""
    with recursive {REACH}, named as (select s.*, w.name from segment s join ways w on s.way_id = w.way_id),
    lines as (
      select region_id, count(*) as segments, count(name) as named_segments, count(distinct name) as trail_names,
        cast(sum(floor(length_mi * 1000e0 + 0.5e0)) as double) / 1000e0 as mi, cast(coalesce(sum(case when name is not null then floor(length_mi * 1000e0 + 0.5e0) end), 0) as double) / 1000e0 as nmi
      from named group by rollup (region_id)),
    j as (select region_id, count(*) as junctions from junction group by rollup (region_id)),
    sizes as (select region_id, component, count(*) as size from spot s join label l on s.node_id = l.node_id group by 1, 2),
    p as (select region_id, count(*) as components, max(size) as largest_component from sizes group by rollup (region_id))
    select j.region_id, segments, named_segments, trail_names, floor(mi * 10e0 + 0.5e0) / 10e0 as total_miles,
      floor(nmi * 10e0 + 0.5e0) / 10e0 as named_miles, cast(floor(nmi / mi * 100e0 + 0.5e0) as bigint) as named_pct, junctions,
      components, largest_component, cast(floor(cast(largest_component as double) / junctions * 100e0 + 0.5e0) as bigint) as largest_component_pct
    from j left join lines on lines.region_id is not distinct from j.region_id left join p on p.region_id is not distinct from j.region_id""",
)
def agg4(spark, sf):
    wn, nodes = network(spark, sf)
    spots = Stages(spark).cut(net.junctions(wn, nodes.filter("kind = 'trailhead'")))
    segs = kept_segments(spark, sf, wn, nodes, spots)
    labels = _labels(spots, segs)
    return net.summarize(segs, spots, comp.component_sizes(labels))


def _components(spark, sf):
    """Labels of the nodes, and the segments they come from."""
    wn, nodes = network(spark, sf)
    spots = Stages(spark).cut(net.junctions(wn, nodes.filter("kind = 'trailhead'")))
    segs = kept_segments(spark, sf, wn, nodes, spots)
    return _labels(spots, segs), segs


def _labels(spots, segs):
    return comp.components(spots, segs.select("region_id", F.col("start_node").alias("src"), F.col("end_node").alias("dst")))


@query("gr3", f"with recursive {REACH} select s.region_id, s.node_id, component from spot s join label l on s.node_id = l.node_id")
def gr3(spark, sf):
    return _components(spark, sf)[0]


@query(
    "top3",
    f"""with recursive {REACH}, sizes as (
          select region_id, component, count(*) as size from spot s join label l on s.node_id = l.node_id group by 1, 2)
        select region_id, component, size, cast(rank as int) as rank from (
          select *, row_number() over (partition by region_id order by size desc, component) as rank from sizes) r where rank <= 5""",
)
def top3(spark, sf):
    return net.top_components(comp.component_sizes(_components(spark, sf)[0]))


SEED = """, main as (
      select l2.node_id from (
        select s.region_id, arg_min(start_node, case when w.name = 'John Muir Trail' then s.seg_id else s.seg_id + 1000000000000 end) as seed
        from segment s join ways w on s.way_id = w.way_id group by s.region_id) f
      join label l1 on l1.node_id = f.seed join label l2 on l2.component = l1.component)"""


def _seeds(segs):
    return segs.select("region_id").distinct().withColumn("seed_trail", F.lit("John Muir Trail"))


@query("gr4", f"with recursive {REACH} {SEED} select s.region_id, m.node_id from main m join spot s on s.node_id = m.node_id")
def gr4(spark, sf):
    labels, segs = _components(spark, sf)
    return comp.main_component(segs, labels, _seeds(segs))


@query("join8", f"with recursive {REACH} {SEED} select region_id, seg_id, length_mi from segment where start_node in (select node_id from main)")
def join8(spark, sf):
    labels, segs = _components(spark, sf)
    main = comp.main_component(segs, labels, _seeds(segs))
    return comp.within(segs, main).select("region_id", "seg_id", "length_mi")


# --- distances -------------------------------------------------------------

NEAR = f"""
    near as (
      select w.region_id, w.way_id, f.feature_id, f.class, f.name, f.type, min({hav("f.lat", "f.lon", "n.lat", "n.lon")}) as gap
      from way_nodes w join nodes n on w.region_id = n.region_id and w.node_id = n.node_id
      join features f on f.region_id = w.region_id
        and n.lat between f.lat - 0.0136e0 and f.lat + 0.0136e0 and n.lon between f.lon - 0.021e0 and f.lon + 0.021e0
      where f.class in ('peak', 'pass', 'spring', 'landmark') group by 1, 2, 3, 4, 5, 6),
    kept as (
      select * from near where gap <= case class when 'peak' then 0.93e0 when 'pass' then 0.25e0 else 0.06e0 end)"""


def line_points(spark, sf):
    return net.located(view(spark, sf, "way_nodes"), view(spark, sf, "nodes"))


def near_points(spark, sf, kinds=("peak", "pass", "spring", "landmark")):
    pts, feats = Stages(spark).cut(line_points(spark, sf)), kept(spark, sf, "features")
    out = None
    for kind in kinds:
        part = distance.nearby(pts, feats.filter(F.col("class") == kind), distance.BUFFER_MI[kind], "way_id").withColumn("class", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("join2", f"with {NEAR} select region_id, way_id, feature_id, class, {r3('gap')} as dist_mi from kept")
def join2(spark, sf):
    return near_points(spark, sf).select("region_id", "way_id", "feature_id", "class", "dist_mi")


@query(
    "join3",
    f"""
    select w.way_id, v.feature_id, v.class, {r3("min(" + hav("v.lat", "v.lon", "n.lat", "n.lon") + ")")} as dist_mi
    from way_nodes w join nodes n on w.region_id = n.region_id and w.node_id = n.node_id
    join water_vertices v on v.region_id = w.region_id
      and n.lat between v.lat - 0.004e0 and v.lat + 0.004e0 and n.lon between v.lon - 0.006e0 and v.lon + 0.006e0
    group by 1, 2, 3
    having min({hav("v.lat", "v.lon", "n.lat", "n.lon")}) <= case v.class when 'lake' then 0.25e0 else 0.031e0 end""",
)
def join3(spark, sf):
    water = distance.sample_water(kept(spark, sf, "water_vertices"))
    pts = Stages(spark).cut(line_points(spark, sf))
    parts = [
        distance.nearby(pts, water.filter(F.col("class") == k), distance.BUFFER_MI[k], "way_id").withColumn("class", F.lit(k))
        for k in ("lake", "stream")
    ]
    return parts[0].unionByName(parts[1]).select("way_id", "feature_id", "class", "dist_mi")


@query(
    "join4",
    """
    with b as (select w.region_id, way_id, min(lat) as min_lat, max(lat) as max_lat, min(lon) as min_lon, max(lon) as max_lon
      from way_nodes w join nodes n on w.region_id = n.region_id and w.node_id = n.node_id group by 1, 2)
    select way_id, feature_id from b join features f on f.region_id = b.region_id
    where lat between min_lat - 0.25e0 / 69e0 and max_lat + 0.25e0 / 69e0
      and lon between min_lon - 0.25e0 / (69e0 * cos(radians(lat))) and max_lon + 0.25e0 / (69e0 * cos(radians(lat)))""",
)
def join4(spark, sf):
    boxes = net.bounding_box(line_points(spark, sf), ["region_id", "way_id"])
    return distance.box_overlap(boxes, view(spark, sf, "features"), 0.25).select("way_id", "feature_id")


@query(
    "join5",
    f"""
    with {NEAR}, c as (select way_id, feature_id, {r3("gap")} as dist_mi from kept where class = 'peak'),
    r as (select *, row_number() over (partition by way_id order by dist_mi, feature_id) as rank from c)
    select way_id, feature_id, dist_mi from r where rank = 1 or dist_mi <= 0.465e0""",
)
def join5(spark, sf):
    peaks = near_points(spark, sf, ("peak",))
    return distance.nearest_peaks(peaks, distance.BUFFER_MI["peak"], "way_id").select("way_id", "feature_id", "dist_mi")


@query(
    "join10",
    f"""
    select a.region_id, a.route_id as a, b.route_id as b, {r3(hav("a.center_lat", "a.center_lon", "b.center_lat", "b.center_lon"))} as dist_mi
    from routes a join routes b on a.region_id = b.region_id and a.route_id < b.route_id
    where {hav("a.center_lat", "a.center_lon", "b.center_lat", "b.center_lon")} < 5e0""",
)
def join10(spark, sf):
    centers = view(spark, sf, "routes").select("region_id", F.col("route_id").alias("id"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    return distance.close_pairs(centers, 5.0)


@query("fn1", f"""
    with p as (select way_id, pos, lat, lon, lag(lat) over (partition by way_id order by pos) as lat0, lag(lon) over (partition by way_id order by pos) as lon0
      from way_nodes w join nodes n on w.region_id = n.region_id and w.node_id = n.node_id)
    select way_id, pos, {r3(hav("lat0", "lon0", "lat", "lon"))} as miles from p where lat0 is not null""")
def fn1(spark, sf):
    from pyspark.sql import Window

    along = Window.partitionBy("way_id").orderBy("pos")
    gap = geo.haversine_miles(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon"))
    return line_points(spark, sf).select("way_id", "pos", geo.round_to(gap, 3).alias("miles")).filter("miles is not null")


@query("fn2", f"select node_id, {r3('1000 * (0.93e0 / 69e0)')} as lat_milli, {r3('1000 * (0.93e0 / (69e0 * cos(radians(lat))))')} as lon_milli from nodes")
def fn2(spark, sf):
    return view(spark, sf, "nodes").select(
        "node_id",
        geo.round_to(geo.lat_buffer(0.93) * 1000, 3).alias("lat_milli"),
        geo.round_to(geo.lon_buffer(0.93, F.col("lat")) * 1000, 3).alias("lon_milli"),
    )


@query("fn3", f"select node_id, {r3('elev_m * 3.28084e0')} as elev_ft from elevation")
def fn3(spark, sf):
    return view(spark, sf, "elevation").select("node_id", geo.round_to(geo.feet(F.col("elev_m")), 3).alias("elev_ft"))


@query("fn4", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, {r3('l_extendedprice * l_discount')} as three, {half('l_extendedprice * l_tax - 500')} as whole from lineitem""")
def fn4(spark, sf):
    from cairn.plans.views import table

    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        geo.round_to(F.col("l_extendedprice") * F.col("l_discount"), 3).alias("three"),
        geo.half_up(F.col("l_extendedprice") * F.col("l_tax") - 500).alias("whole"),
    )


# --- elevation -------------------------------------------------------------


def series(spark, sf):
    from cairn.operators.ordering import numbered

    events = view(spark, sf, "series").drop("pos")
    placed = numbered(events, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")])
    return placed.select("user_id", "event_id", "pos", geo.feet(F.col("elev_m")).alias("elev_ft"))


SMOOTH = """
    smooth as (
      select user_id, event_id, pos, ft, case when pos = 0 or pos = last_pos then ft else mean_ft end as smooth_ft from (
        select user_id, event_id, pos, elev_m * 3.28084e0 as ft, max(pos) over (partition by user_id) as last_pos,
          avg(elev_m * 3.28084e0) over (partition by user_id order by pos rows between 2 preceding and 2 following) as mean_ft
        from series) x),
    step as (select *, smooth_ft - lag(smooth_ft) over (partition by user_id order by pos) as delta from smooth)"""


@query("win1", f"with {SMOOTH} select user_id, event_id, pos, {r3('smooth_ft')} as smooth_ft from smooth")
def win1(spark, sf):
    return round3(elev.smooth(series(spark, sf), ["user_id"]), "smooth_ft").select("user_id", "event_id", "pos", "smooth_ft")


@query("win2", f"with {SMOOTH} select user_id, event_id, {r3('delta')} as delta from step")
def win2(spark, sf):
    smooth = elev.smooth(series(spark, sf), ["user_id"])
    return round3(elev.deltas(smooth, ["user_id"]), "delta").select("user_id", "event_id", "delta")


GAIN = f"""
    {SMOOTH}, sums as (
      select user_id, sum(case when delta > 10 then delta else 0 end) as up, sum(case when delta < -10 then -delta else 0 end) as down,
        arg_max(ft, pos) - arg_min(ft, pos) as net, count(*) as n from step group by user_id)"""


@query(
    "agg5",
    f"""with {GAIN} select user_id,
          {half("up + case when up + down > 0 and net - (up - down) > 0 then net - (up - down) else 0 end")} as gain_ft,
          {half("down + case when up + down > 0 and net - (up - down) <= 0 then -(net - (up - down)) else 0 end")} as loss_ft
        from sums where n >= 2""",
)
def agg5(spark, sf):
    return elev.gain_loss(elev.smooth(series(spark, sf), ["user_id"]), ["user_id"])


def seg_like(spark, sf):
    """Whole ways as segments."""
    wn = view(spark, sf, "way_nodes")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda v: v["node_id"])
    return wn.groupBy("region_id", F.col("way_id").alias("seg_id")).agg(ids.alias("node_ids")).filter(F.size("node_ids") > 1)


@query(
    "top8",
    """select way_id as seg_id, pos from (select *, max(pos) over (partition by way_id) as last_pos from way_nodes) w
       where last_pos > 0 and (pos % 2 = 0 or pos = last_pos)""",
)
def top8(spark, sf):
    return elev.sampled_positions(seg_like(spark, sf), 2).select("seg_id", F.col("pos").cast("long").alias("pos"))


@query(
    "join6",
    """select w.way_id as seg_id, w.pos, e.elev_m from (select *, max(pos) over (partition by way_id) as last_pos from way_nodes) w
       left join elevation e on e.node_id = w.node_id where last_pos > 0""",
)
def join6(spark, sf):
    samples = elev.sampled_positions(seg_like(spark, sf))
    return samples.join(view(spark, sf, "elevation"), "node_id", "left").select("seg_id", F.col("pos").cast("long").alias("pos"), "elev_m")


@query(
    "join7",
    """select distinct n.region_id, n.node_id from nodes n join (select node_id from way_nodes where way_id in (
         select way_id from way_nodes where pos = 1)) w on w.node_id = n.node_id
       where not exists (select 1 from elevation e where e.node_id = n.node_id)""",
)
def join7(spark, sf):
    needed = elev.needed_nodes(elev.sampled_positions(seg_like(spark, sf)), view(spark, sf, "nodes"))
    return elev.missing_elevation(needed, view(spark, sf, "elevation")).select("region_id", "node_id")


@query(
    "win10",
    """select node_id, cast(floor((row_number() over (partition by node_id % 5 order by node_id) - 1) / 100) as bigint) as batch
       from nodes""",
)
def win10(spark, sf):
    nodes = view(spark, sf, "nodes").withColumn("region_id", F.col("node_id") % 5)
    return elev.batched(nodes, bucket=4096).select("node_id", "batch")


# --- summaries of walks ----------------------------------------------------


@query(
    "gr5",
    f"""
    with recursive {SEGMENTS}, hop as (
      select region_id, a, b, min(mi) as mi from (
        select region_id, start_node as a, end_node as b, length_mi as mi from segment
        union all select region_id, end_node, start_node, length_mi from segment) e where a <> b group by 1, 2, 3),
    d as (select region_id, node_id, count(*) as degree from (
        select region_id, start_node as node_id from segment union all select region_id, end_node from segment) e group by 1, 2),
    anchor as (select d.region_id, d.node_id from d left join trailheads h on h.node_id = d.node_id
      where degree >= 3 or (h.node_id is not null and degree >= 2)),
    step as (select a, b, min(mi) as mi from hop group by 1, 2),
    home(anchor, node_id, dist) using key (anchor, node_id) as (
      select node_id, node_id, 0e0 from anchor
      union
      select h.anchor, p.b, min(h.dist + p.mi) from home h join step p on p.a = h.node_id
        left join recurring.home o on o.anchor = h.anchor and o.node_id = p.b
      where h.dist + p.mi <= 22.5e0 and h.dist + p.mi < coalesce(o.dist, 1e9) group by 1, 2)
    select anchor, node_id, {r3("dist")} as dist from home""",
)
def gr5(spark, sf):
    wn, nodes = network(spark, sf)
    segs = kept_segments(spark, sf, wn, nodes)
    anchors = walks.start_nodes(segs, nodes.filter("kind = 'trailhead'"))
    return round3(walks.shortest_miles(anchors, walks.directed_edges(segs), walks.MAX_MI / 2), "dist").select("anchor", "node_id", "dist")
