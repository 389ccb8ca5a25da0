"""Route-shaped views of the business tables, for checks and benchmarks.

Every view reads its tables whole. Keys are spread over regions by arithmetic
that Spark and DuckDB evaluate alike, so both see the same network. The text is
shared; what is computed on top of a view is written twice, independently.

A customer is a network region: its orders are ways, their line items are the
vertices, one of 24 nodes each. An order is also a feature next to one of the
nodes. Regions therefore multiply with the data and stay small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairn.session import Stages, bound_tasks

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# words that become names; picked by key
TITLE = (
    "case {0} % 8 when 0 then 'Amber' when 1 then 'Birch' when 2 then 'Cedar' when 3 then 'Dome' "
    "when 4 then 'Eagle' when 5 then 'Fern' when 6 then 'Granite' else 'Heron' end || ' ' || "
    "case {0} % 3 when 0 then 'Lake' when 1 then 'Ridge' else 'Meadow' end"
)

_LAT0 = "33e0 + cast({r} * 7919 % 10007 as double) / 10007e0 * 14e0"
_LON0 = "-121e0 + cast({r} * 104729 % 10007 as double) / 10007e0 * 40e0"
_J = "cast(floor({k} / 2) as bigint)"
_LAT = _LAT0 + " + cast({j} * 5 % 12 as double) / 12e0 * 0.6e0 + cast(({r} * 31 + {j} * 17) % 97 as double) / 97e0 * 0.015e0"
_LON = _LON0 + " + cast({j} * 7 % 12 as double) / 12e0 * 0.75e0 + cast(({k} % 2) * ({j} % 8) as double) * 0.00001e0"


def _at(template: str, r: str, k: str) -> str:
    return template.format(r=r, k=k, j=_J.format(k=k))


VIEWS = {
    "ways": """
        select o_custkey as region_id, o_orderkey as way_id, o_orderkey as way_no,
          case o_orderkey % 11 when 0 then 'John Muir Trail' when 1 then 'Pacific Crest Trail'
            when 2 then null when 3 then null else 'Trail ' || cast(o_orderkey % 11 as string) end as name,
          case when o_orderkey % 4 = 0 then 'hiking' end as sac_scale
        from orders""",
    "way_nodes": """
        select o_custkey as region_id, l_orderkey as way_id,
          cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as bigint) as pos,
          o_custkey * 100 + l_partkey % 24 as node_id
        from lineitem join orders on l_orderkey = o_orderkey""",
    "nodes": f"""
        select region_id, node_id,
          {_at(_LAT, "region_id", "(node_id % 100)")} as lat,
          {_at(_LON, "region_id", "(node_id % 100)")} as lon,
          case when (node_id % 100) % 9 = 0 then 'trailhead' else 'plain' end as kind,
          case when node_id * 7 % 13 <> 0 then 1500e0 + cast(node_id * 37 % 997 as double) * 0.35e0 end as elev_m
        from (select distinct region_id, node_id from way_nodes) d""",
    "trailheads": """
        select region_id, node_id, 'Trailhead ' || cast(node_id % 100 as string) as name
        from nodes where kind = 'trailhead'""",
    "boxes": f"""
        select region_id, {_LAT0.format(r="region_id")} as min_lat, {_LON0.format(r="region_id")} as min_lon,
          {_LAT0.format(r="region_id")} + 0.555e0 as max_lat, {_LON0.format(r="region_id")} + 0.7e0 as max_lon
        from (select distinct o_custkey as region_id from orders) d""",
    "features": f"""
        select region_id, feature_id, class, nullif(title || word, '') as name, type,
          lat0 + cast((feature_id * 13 % 41) - 20 as double) / 41e0 * reach as lat,
          lon0 + cast((feature_id * 29 % 37) - 18 as double) / 37e0 * reach as lon
        from (
          select o_custkey as region_id, o_orderkey as feature_id,
            case o_orderkey % 7 when 1 then 'pass' when 2 then 'spring' when 3 then 'landmark'
              when 4 then 'lake' when 5 then 'stream' else 'peak' end as class,
            case o_orderkey % 7 when 1 then 'saddle' when 2 then 'spring' when 3 then 'waterfall'
              when 4 then 'water' when 5 then 'stream' else 'peak' end as type,
            case when o_orderkey % 9 = 0 and o_orderkey % 7 in (1, 2, 3) then '' else {TITLE.format("o_orderkey")} end as title,
            case when o_orderkey % 9 = 0 and o_orderkey % 7 in (1, 2, 3) then '' else ' ' || cast(o_orderkey % 50 as string) end as word,
            case o_orderkey % 3 when 0 then 0.02e0 when 1 then 0.004e0 else 0.001e0 end as reach,
            {_at(_LAT, "o_custkey", "(o_orderkey * 5 % 24)")} as lat0,
            {_at(_LON, "o_custkey", "(o_orderkey * 5 % 24)")} as lon0
          from orders) o""",
    "water_vertices": """
        select region_id, feature_id, class, name, type, cast(i as bigint) as pos, cast(5 as bigint) as node_count,
          lat + cast(i as double) * 0.0007e0 as lat, lon + cast(i * i % 3 as double) * 0.0009e0 as lon
        from features {series5} where class in ('lake', 'stream')""",
    "elevation": """
        select node_id, elev_m from nodes where elev_m is not null""",
    "series": """
        select user_id, ts, event_id, value as elev_m,
          cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as pos
        from events""",
    # an order as a route of its line items
    "legs": f"""
        select l_orderkey as request_id, o_custkey as cust_id,
          cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as int) as seg_idx,
          case l_suppkey % 6 when 0 then 'John Muir Trail' when 1 then 'Pacific Crest Trail' when 2 then '(unnamed)'
            else 'Trail ' || cast(l_suppkey % 6 as string) end as trail_name,
          case when l_partkey % 10 = 0 then 'Trail ' || cast(l_partkey % 7 as string) else
            case l_suppkey % 6 when 0 then 'John Muir Trail' when 1 then 'Pacific Crest Trail' when 2 then '(unnamed)'
            else 'Trail ' || cast(l_suppkey % 6 as string) end end as told_trail,
          l_quantity / 4e0 as length_mi,
          cast(floor(l_extendedprice / 50e0) as bigint) as gain_ft,
          cast(floor(l_extendedprice * (1e0 - l_discount) / 50e0) as bigint) as loss_ft,
          {TITLE.format("l_partkey")} as feature, {TITLE.format("(l_suppkey + 3)")} as rumour,
          case p_type when 'ECONOMY' then 'lakes' when 'STANDARD' then 'peaks' when 'PROMO' then 'passes'
            when 'SMALL' then 'streams' when 'MEDIUM' then 'springs' else 'landmarks' end as category,
          case p_type when 'ECONOMY' then 'lake' when 'STANDARD' then 'peak' when 'PROMO' then 'saddle'
            when 'SMALL' then 'water' when 'MEDIUM' then 'waterfall' else 'spring' end as type,
          l_returnflag, l_quantity, l_suppkey, l_partkey
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "leg_days": """
        select request_id, cast(1 + floor(seg_idx / 2) as int) as day,
          sum(length_mi) as miles,
          cast(sum(gain_ft) as bigint) as gain_ft, cast(sum(loss_ft) as bigint) as loss_ft,
          min(feature) as feature, min(rumour) as rumour
        from legs group by request_id, cast(1 + floor(seg_idx / 2) as int)""",
    "notes": """
        select request_id, day, miles, gain_ft, loss_ft,
          'Descend ' || feature || ' then camp near ' || rumour || '. Walk '
          || cast(cast(floor(miles) as bigint) + request_id % 3 as string) || ' miles, climb '
          || cast(gain_ft + (request_id % 5) * 60 as string) || ' ft and carry water to ' || rumour || '.' as note
        from leg_days""",
    "given": """
        select request_id, floor(sum(l_quantity) / 4e0 * 10e0 + 0.5e0) / 10e0 as total_miles,
          floor(sum(l_quantity) / 4e0 * 10e0 + 0.5e0) / 10e0 + cast(request_id % 4 as double) * 0.2e0 as told_miles,
          cast(sum(gain_ft) as bigint) + (request_id % 3) * 40 as total_gain_ft,
          cast(sum(loss_ft) as bigint) - (request_id % 4) * 30 as total_loss_ft,
          cast(count(*) as bigint) as segments, cast(1 + request_id % 4 as int) as days,
          '~' || cast(8 + request_id % 9 as string) as miles_per_day_text
        from legs group by request_id""",
    # what was written about an order, for every rule on texts
    "told": """
        select o_orderkey as request_id,
          case o_orderkey % 11 when 3 then '' when 7 then 'undefined' else 'Route ' || cast(o_orderkey as string) end as route_name,
          case when o_orderkey % 13 = 5 then 'A Stunning way over pristine ground' else 'Quiet valleys and ridges' end as summary,
          'walkers with time' as best_for,
          case o_orderkey % 4 when 0 then 'Views. Lakes. Peaks!' when 1 then 'Camp near ' || coalesce(feature, 'water') when 2 then 'Seven calm days' else 'Long and lonely' end as pro,
          case o_orderkey % 5 when 0 then 'Crowded in July. Hot. Dry.' when 1 then 'About 12 miles without water' else 'A steep start' end as con,
          case when o_orderkey % 17 = 4 then 'A bear canister – rented' else 'A bear canister' end as gear
        from orders left join (select request_id, min(feature) as feature from legs group by request_id) f on f.request_id = o_orderkey""",
    # an order as a finished route to score
    "routes": f"""
        select request_id as route_id, cast(floor(cust_id / 10) as bigint) as region_id,
          floor(sum(l_quantity) / 3e0 * 10e0 + 0.5e0) / 10e0 as miles,
          cast(sum(gain_ft) * 2 as bigint) as gain_ft, cast(sum(loss_ft) * 2 as bigint) as loss_ft,
          sum(case when l_returnflag = 'R' then l_quantity else 0e0 end) / sum(l_quantity) as ht_ratio,
          cast(count(*) * (1 + request_id % 5) as bigint) as feature_count,
          cast(count(distinct l_suppkey % 6) as bigint) as trailhead_count,
          cast(count(distinct trail_name) as bigint) as trail_count,
          cast(sum(case when type in ('lake', 'water') then 1 else 0 end) as bigint) as n_lakes,
          cast(sum(case when type = 'peak' then 1 else 0 end) as bigint) as n_peaks,
          cast(sum(case when type = 'saddle' then 1 else 0 end) as bigint) as n_passes,
          cast(sum(case when type = 'waterfall' then 1 else 0 end) as bigint) as n_falls,
          {_LAT0.format(r="cast(floor(cust_id / 10) as bigint)")} + cast(request_id * 13 % 101 as double) / 101e0 * 0.35e0 as center_lat,
          {_LON0.format(r="cast(floor(cust_id / 10) as bigint)")} + cast(request_id * 37 % 103 as double) / 103e0 * 0.40e0 as center_lon
        from legs group by request_id, cust_id""",
    "prefs": """
        select c_custkey as pref_id, cast(floor(c_custkey / 10) as bigint) as region_id,
          cast(2 + c_custkey % 5 as int) as days, 6e0 + cast(c_custkey % 9 as double) * 0.5e0 as miles_per_day,
          case c_nationkey % 4 when 0 then 'easy' when 1 then 'moderate' when 2 then 'hard' else 'any' end as tolerance,
          case c_custkey % 6 when 0 then '' when 1 then 'lakes' when 2 then 'peaks,lakes' when 3 then 'passes,alpine'
            when 4 then 'forest,meadows' else 'waterfalls,lakes,alpine' end as scenery_text,
          case c_mktsegment when 'HOUSEHOLD' then 'popular' when 'MACHINERY' then 'solitude' when 'BUILDING' then 'solitude'
            else 'mixed' end as crowd
        from customer""",
    # nations as regions with permit rules, events as permit slots, customers as travellers
    "regions": "select cast(n_nationkey as bigint) as region_id, n_name as name from nation",
    "registry": """
        select cast(n_nationkey as bigint) as region_id, n_nationkey % 5 <> 0 as permit_required,
          n_name || ' Permit' as permit_name,
          case when n_nationkey % 7 = 3 then null else 'p' || cast(n_nationkey as string) end as permit_id,
          n_nationkey % 4 = 1 as is_lottery, 'https://example.org/' || cast(n_nationkey as string) as booking_url,
          case when n_nationkey % 6 < 5 then split('June,' || case when n_nationkey % 2 = 0 then 'July' else 'May' end, ',') end as best_months
        from nation where n_name <> 'NATION_10' and n_name <> 'NATION_21'""",
    "slots": """
        select 'p' || cast(user_id % 25 as string) as permit_id, cast(ts as date) as date, event_type,
          case event_type when 'purchase' then 'Available' when 'view' then 'AVAILABLE' else 'Full' end as status, ts, event_id
        from events where event_type <> 'error'""",
    "alerts": """
        select cast(c_custkey as string) as id, 'u' || cast(c_custkey % 700 as string) || '@example.org' as email,
          cast(c_nationkey as bigint) as region_id,
          case when c_custkey % 8 = 0 then null else cast('2024-01-01' as date) + cast(c_custkey % 31 as int) end as start_date
        from customer""",
    "log": """
        select ts, 'ip' || cast(user_id as string) as ip, event_type as path,
          case when event_type = 'error' then 500 else 200 end as status, cast(floor(value * 10e0) as bigint) as ms, event_id
        from events""",
    "docs": "select doc_id as request_id, text from documents",
}

_ENGINE = {
    "spark": {"series5": "lateral view explode(array(0, 1, 2, 3, 4)) v as i"},
    "duckdb": {"series5": ", unnest([0, 1, 2, 3, 4]) as v(i)"},
}
_WORD = re.compile(r"[a-z_0-9]+")


def _needs(text: str, given: tuple[str, ...] = ()) -> list[str]:
    """Views a text refers to, in dependency order, but for those that are given."""
    out: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(_WORD.findall(sql)):
            if word in VIEWS and re.search(rf"(from|join)\s+{word}\b", sql) and word not in out and word not in given:
                visit(VIEWS[word])
                out.append(word)

    visit(text)
    return out


def with_views(text: str, engine: str = "duckdb", given: tuple[str, ...] = ()) -> str:
    """The text with the views it uses in front, as one statement."""
    parts = [f"{name} as ({VIEWS[name].format(**_ENGINE[engine])})" for name in _needs(text, given)]
    body = text.strip()
    if not parts:
        return body
    lead = "with recursive " if body.lower().startswith("with recursive") else "with "
    if body.lower().startswith("with"):
        body = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body)
        return lead + ",\n".join(parts) + ",\n" + body
    return lead + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_tasks(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view as a DataFrame over the tables of a folder; ``given`` views are at hand and not made again."""
    text = with_views(f"select * from {name}", "spark", tuple(given))
    for base in TABLES:
        if re.search(rf"(from|join)\s+{base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    for at_hand, rows in given.items():
        rows.createOrReplaceTempView(at_hand)
    return spark.sql(text)


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view written once, for queries that read it several times as they would a table."""
    return Stages(spark).cut(view(spark, sf_dir, name))


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vertices of ways and the nodes made of them, each written once."""
    way_nodes = kept(spark, sf_dir, "way_nodes")
    return way_nodes, Stages(spark).cut(view(spark, sf_dir, "nodes", way_nodes=way_nodes))
