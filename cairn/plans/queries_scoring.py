"""Queries over scores and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geo, hiking
from cairn.operators import itinerary, ranking, scoring
from cairn.plans.registry import half, hav, query, r1
from cairn.plans.views import view
from cairn.session import Stages


def prefs(spark, sf):
    words = F.filter(F.split("scenery_text", ","), lambda w: w != "")
    return view(spark, sf, "prefs").withColumn("scenery", words).drop("scenery_text")


def routes(spark, sf):
    types = F.concat(
        *[F.array_repeat(F.lit(t), F.col(n).cast("int")) for t, n in (("lake", "n_lakes"), ("peak", "n_peaks"), ("saddle", "n_passes"), ("waterfall", "n_falls"))]
    )
    return view(spark, sf, "routes").select(
        "route_id", "region_id", "miles", "gain_ft", "loss_ft", "ht_ratio", "feature_count", "trailhead_count", "trail_count",
        F.col("n_lakes").alias("distinct_lakes"), F.col("n_peaks").alias("distinct_peaks"), F.col("n_passes").alias("distinct_passes"),
        "center_lat", "center_lon", types.alias("feature_types"),
    )


def scored(spark, sf):
    return scoring.score_routes(prefs(spark, sf), routes(spark, sf))


def kept(spark, sf):
    """Scores written once, where several steps read them."""
    return Stages(spark).cut(scored(spark, sf).select("profile", "route_id", "score", "center_lat", "center_lon"))


def per_pref(spark, sf, df, few=False):
    return scoring.per_traveller(prefs(spark, sf), df, few)


def _has(word: str) -> str:
    return f"(',' || scenery_text || ',') like '%,{word},%'"


_COUNTS = {"lakes": "n_lakes", "peaks": "n_peaks", "passes": "n_passes", "waterfalls": "n_falls"}
_MATCHED = " + ".join(
    [f"case when {_has(w)} and {n} > 0 then 1 else 0 end" for w, n in _COUNTS.items()]
    + [
        f"case when {_has('forest')} and ht_ratio < 0.2e0 then 1 else 0 end",
        f"case when {_has('alpine')} and (n_peaks > 0 or n_passes > 0) and gain_ft / days > 2000 then 1 else 0 end",
    ]
)
_BONUS = " + ".join(f"case when {_has(w)} and {n} > 1 then least(15, ({n} - 1) * 5) else 0 end" for w, n in _COUNTS.items())
_CENTER = "case tolerance when 'easy' then 750e0 when 'hard' then 3750e0 else 2250e0 end"
_REACH = "case tolerance when 'hard' then 2500e0 else 2250e0 end"
PARTS = f"""
    pair as (select p.*, r.route_id, r.miles, r.gain_ft, r.ht_ratio, r.feature_count, r.trailhead_count, r.n_lakes, r.n_peaks, r.n_passes, r.n_falls,
        r.center_lat, r.center_lon, case when scenery_text = '' then 0 else length(scenery_text) - length(replace(scenery_text, ',', '')) + 1 end as wanted
      from prefs p join routes r on p.region_id = r.region_id),
    part_scores as (select *,
        {half("greatest(0e0, least(100e0, 100e0 - abs(miles / days - miles_per_day) / miles_per_day * 200e0))")} as mileage_fit,
        {half(f"100e0 * greatest(0e0, 1e0 - power(abs(gain_ft / days - {_CENTER}) / ({_REACH}), 2))")} as elevation_fit,
        case when wanted = 0 then 50 else {half(f"least(100e0, cast({_MATCHED} as double) / wanted * 80e0 + ({_BONUS}))")} end as scenery_match,
        {half("greatest(0e0, least(100e0, case crowd when 'popular' then 30e0 + least(70e0, ht_ratio / 0.5e0 * 70e0) when 'solitude' then 100e0 - least(70e0, ht_ratio / 0.5e0 * 70e0) else greatest(60e0, 100e0 - abs(ht_ratio - 0.25e0) / 0.35e0 * 40e0) end))")} as crowd_match,
        cast(least(100, (case when trailhead_count = 0 then 1 else trailhead_count end) * 20) as bigint) as accessibility,
        {half("least(1e0, feature_count / greatest(1e0, miles) / 0.6e0) * 100e0")} as feature_density
      from pair),
    score as (select *,
        {half("(mileage_fit / 100e0 * 25 + elevation_fit / 100e0 * 20 + scenery_match / 100e0 * 20 + crowd_match / 100e0 * 15 + accessibility / 100e0 * 10 + feature_density / 100e0 * 10) / 100e0 * 100e0")} as score
      from part_scores)"""


def _part(name: str, key: str) -> None:
    @query(key, f"with {PARTS} select pref_id, route_id, {name} from part_scores")
    def run(spark, sf):
        return per_pref(spark, sf, scored(spark, sf).select("profile", "route_id", name)).select("pref_id", "route_id", name)


for _key, _name in {
    "sc1": "mileage_fit",
    "sc2": "elevation_fit",
    "sc3": "scenery_match",
    "sc4": "crowd_match",
    "sc5": "accessibility",
    "sc6": "feature_density",
}.items():
    _part(_name, _key)


@query("sc7", f"with {PARTS} select pref_id, route_id, score from score")
def sc7(spark, sf):
    return per_pref(spark, sf, scored(spark, sf).select("profile", "route_id", "score")).select("pref_id", "route_id", "score")


@query("join9", "select p.pref_id, r.route_id from prefs p join routes r on p.region_id = r.region_id")
def join9(spark, sf):
    from cairn.operators.ordering import spread_join

    return spread_join(
        routes(spark, sf).select("region_id", "route_id"), prefs(spark, sf).select("region_id", "pref_id"), ["region_id"], "route_id"
    ).select("pref_id", "route_id")


_FAR = lambda a: f"{hav(f'{a}.center_lat', f'{a}.center_lon', 's.center_lat', 's.center_lon')} >= 5e0"
PICKS = f"""
    {PARTS},
    fit as (select * from (select *, max(score) over (partition by pref_id) as top_score,
        row_number() over (partition by pref_id order by score desc, route_id) as raw_rank from score) s where score >= top_score - 7),
    pick1 as (select * from fit where raw_rank = 1),
    left2 as (select s.* from fit s join pick1 a on s.pref_id = a.pref_id where s.raw_rank > 1 and {_FAR("a")}),
    pick2 as (select * from (select *, row_number() over (partition by pref_id order by raw_rank) as n from left2) x where n = 1),
    left3 as (select s.* from left2 s join pick2 a on s.pref_id = a.pref_id where s.raw_rank > a.raw_rank and {_FAR("a")}),
    pick3 as (select * from (select *, row_number() over (partition by pref_id order by raw_rank) as n from left3) x where n = 1),
    pick as (select pref_id, 0 as pick_idx, route_id, score, raw_rank, center_lat, center_lon from pick1
      union all select pref_id, 1, route_id, score, raw_rank, center_lat, center_lon from pick2
      union all select pref_id, 2, route_id, score, raw_rank, center_lat, center_lon from pick3)"""


@query("top1", f"with {PARTS} select pref_id, route_id, score, cast(raw_rank as int) as raw_rank from (select *, row_number() over (partition by pref_id order by score desc, route_id) as raw_rank from score) s where raw_rank <= 10")
def top1(spark, sf):
    best = ranking.leaders(scored(spark, sf).select("profile", "route_id", "score"))
    return per_pref(spark, sf, best, few=True).select("pref_id", "route_id", "score", "raw_rank")


@query("win7", f"with {PARTS} select pref_id, route_id, row_number() over (partition by pref_id order by score desc, route_id) as raw_rank from score")
def win7(spark, sf):
    return per_pref(spark, sf, ranking.ranked(kept(spark, sf))).select("pref_id", "route_id", "raw_rank")


@query("win8", f"with {PARTS} select pref_id, route_id, score, top_score from (select *, max(score) over (partition by pref_id) as top_score from score) s where score >= top_score - 7")
def win8(spark, sf):
    return per_pref(spark, sf, ranking.eligible(kept(spark, sf))).select("pref_id", "route_id", "score", "top_score")


@query("top2", f"with {PICKS} select pref_id, cast(pick_idx as int) as pick_idx, route_id, score, count(*) over (partition by pref_id) >= 3 as complete from pick")
def top2(spark, sf):
    picks = ranking.diverse_top(scored(spark, sf))
    return per_pref(spark, sf, picks, few=True).select("pref_id", "pick_idx", "route_id", "score", "complete")


@query("sc8", f"with {PICKS} select pref_id, cast(pick_idx as int) as pick_idx, route_id, score, raw_rank, count(*) over (partition by pref_id) >= 3 as complete from pick")
def sc8(spark, sf):
    """The best three routes, well apart, for every traveller, with their place in the full order."""
    every = kept(spark, sf)
    picks = ranking.diverse_top(every)
    ranks = ranking.raw_ranks(picks, every)
    return per_pref(spark, sf, picks.join(ranks, ["profile", "pick_idx", "route_id"]), few=True).select(
        "pref_id", "pick_idx", "route_id", "score", "raw_rank", "complete"
    )


@query(
    "agg20",
    f"""
    with {PICKS}, zone as (select *, max(score) over (partition by pref_id) as top_score from score),
    seen as (
      select z.pref_id, z.route_id, z.score, z.top_score, bool_or(k.route_id = z.route_id) as picked,
        arg_min(k.route_id, k.pick_idx) filter ({hav("k.center_lat", "k.center_lon", "z.center_lat", "z.center_lon")} < 5e0) as blocked_by,
        arg_min({hav("k.center_lat", "k.center_lon", "z.center_lat", "z.center_lon")}, k.pick_idx) filter ({hav("k.center_lat", "k.center_lon", "z.center_lat", "z.center_lon")} < 5e0) as mi
      from zone z join pick k on k.pref_id = z.pref_id where z.score >= z.top_score - 12 group by 1, 2, 3, 4)
    select * from (select pref_id, route_id, score, case when picked then 'accepted' when score >= top_score - 7 and blocked_by is not null then 'filtered'
        when score < top_score - 7 and blocked_by is null then 'near_miss' end as outcome, blocked_by, {r1("mi")} as blocked_mi from seen) x where outcome is not null""",
)
def agg20(spark, sf):
    every = kept(spark, sf)
    report = ranking.filter_report(every, ranking.diverse_top(every))
    return per_pref(spark, sf, report).select("pref_id", "route_id", "score", "outcome", "blocked_by", "blocked_mi")


@query(
    "prj13",
    """select route_id, case when n_passes >= 2 then 'high-passes' when ht_ratio < 0.15e0 then 'remote' when n_lakes >= 8 then 'scenic'
         when trail_count >= 6 then 'explorer' when route_id % 3 = 0 then 'classic' when route_id % 3 = 1 then 'scenic' else 'explorer' end as archetype from routes""",
)
def prj13(spark, sf):
    return routes(spark, sf).select(
        "route_id",
        itinerary.archetype(F.col("distinct_passes"), F.col("ht_ratio"), F.col("distinct_lakes"), F.col("trail_count"), F.col("route_id") % 3).alias("archetype"),
    )


@query("fn14", f"select route_id, gain_ft - loss_ft as net_ft, {half('gain_ft / miles')} as per_mile, {half('gain_ft / 4e0')} as per_day from routes")
def fn14(spark, sf):
    return view(spark, sf, "routes").select(
        "route_id",
        hiking.net_ft(F.col("gain_ft"), F.col("loss_ft")).alias("net_ft"),
        hiking.per(F.col("gain_ft"), F.col("miles")).alias("per_mile"),
        hiking.per(F.col("gain_ft"), F.lit(4)).alias("per_day"),
    )
