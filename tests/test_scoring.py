"""Score rows with known answers, algebraic properties, and the choice of routes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import ranking, scoring

ROUTE = "route_id long, region_id long, miles double, gain_ft long, ht_ratio double, feature_count long, trailhead_count long, distinct_peaks long, distinct_passes long, center_lat double, center_lon double, feature_types array<string>"
PREF = "pref_id long, region_id long, days int, miles_per_day double, tolerance string, scenery array<string>, crowd string"
BASE_R = dict(route_id=1, region_id=1, miles=40.0, gain_ft=9000, ht_ratio=0.25, feature_count=18, trailhead_count=3, distinct_peaks=1, distinct_passes=0, center_lat=37.7, center_lon=-119.1, feature_types=["lake"] * 4 + ["peak"])
BASE_P = dict(pref_id=1, region_id=1, days=4, miles_per_day=10.0, tolerance="moderate", scenery=["lakes"], crowd="mixed")

CASES = [
    ({}, {}, "mileage_fit", 100),
    (dict(miles=60.0), {}, "mileage_fit", 0),
    (dict(miles=50.0), {}, "mileage_fit", 50),
    ({}, {}, "elevation_fit", 100),
    (dict(gain_ft=6000), {}, "elevation_fit", 89),
    (dict(gain_ft=0), {}, "elevation_fit", 0),
    (dict(gain_ft=3000), dict(tolerance="easy"), "elevation_fit", 100),
    (dict(gain_ft=15000), dict(tolerance="hard"), "elevation_fit", 100),
    ({}, dict(scenery=[]), "scenery_match", 50),
    (dict(feature_types=["lake"]), {}, "scenery_match", 80),
    ({}, {}, "scenery_match", 95),
    (dict(feature_types=[]), dict(scenery=["passes"]), "scenery_match", 0),
    ({}, dict(scenery=["lakes", "passes"]), "scenery_match", 55),
    (dict(distinct_peaks=2, gain_ft=10000), dict(scenery=["alpine"]), "scenery_match", 80),
    (dict(distinct_peaks=2, gain_ft=4000), dict(scenery=["alpine"]), "scenery_match", 0),
    (dict(ht_ratio=0.6), dict(crowd="popular"), "crowd_match", 100),
    (dict(ht_ratio=0.0), dict(crowd="solitude"), "crowd_match", 100),
    ({}, {}, "crowd_match", 100),
    (dict(trailhead_count=1), {}, "accessibility", 20),
    (dict(trailhead_count=5), {}, "accessibility", 100),
    (dict(trailhead_count=10), {}, "accessibility", 100),
    (dict(trailhead_count=0), {}, "accessibility", 20),
    (dict(feature_count=0), {}, "feature_density", 0),
    (dict(feature_count=12), {}, "feature_density", 50),
    (dict(feature_count=24), {}, "feature_density", 100),
    (dict(feature_count=100), {}, "feature_density", 100),
    ({}, {}, "score", 93),
    (
        dict(miles=37.5, gain_ft=14225, feature_count=25, feature_types=["lake"] * 15 + ["peak"] * 4, ht_ratio=0.29, trailhead_count=5),
        dict(scenery=["lakes", "peaks"]),
        "score",
        89,
    ),
]


@pytest.fixture(scope="module")
def answers(spark):
    routes, prefs = [], []
    for i, (r, p, _, _) in enumerate(CASES):
        routes.append({**BASE_R, **r, "route_id": i, "region_id": i})
        prefs.append({**BASE_P, **p, "pref_id": i, "region_id": i})
    scored = scoring.score_routes(spark.createDataFrame(prefs, PREF), spark.createDataFrame(routes, ROUTE))
    return {r["route_id"]: r for r in scored.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_part(answers, i):
    _, _, part, expected = CASES[i]
    assert answers[i][part] == expected


def test_symmetry_and_complement(spark):
    routes = [{**BASE_R, "route_id": i, "region_id": 1, "miles": m, "ht_ratio": 0.3} for i, m in enumerate((48.0, 32.0))]
    prefs = [{**BASE_P, "pref_id": i, "crowd": c} for i, c in enumerate(("popular", "solitude"))]
    rows = scoring.score_routes(spark.createDataFrame(prefs, PREF), spark.createDataFrame(routes, ROUTE)).collect()
    assert len({r["mileage_fit"] for r in rows}) == 1
    by = {(r["route_id"], r["crowd"]): r["crowd_match"] for r in rows}
    assert by[0, "popular"] + by[0, "solitude"] == 130


def miles(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(h))


def test_diverse_top_against_walk(spark):
    rnd = random.Random(5)
    rows = [
        (f"p{p}", i, rnd.randint(70, 90), 37.5 + rnd.random() * 0.2, -119.0 + rnd.random() * 0.2)
        for p in range(6)
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "profile string, route_id long, score long, center_lat double, center_lon double")
    got = {}
    for r in ranking.diverse_top(df.repartition(7)).collect():
        got.setdefault(r["profile"], {})[r["pick_idx"]] = r["route_id"]
    for p in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[2], r[1]))
        chosen = []
        for r in mine:
            if len(chosen) == 3 or r[2] < mine[0][2] - 7:
                break
            if all(miles(r[3:], c[3:]) >= 5 for c in chosen):
                chosen.append(r)
        assert got[p] == {i: c[1] for i, c in enumerate(chosen)}
    ranks = {(r["profile"], r["route_id"]): r["raw_rank"] for r in ranking.ranked(df).collect()}
    for r in ranking.raw_ranks(ranking.diverse_top(df), df).collect():
        assert ranks[r["profile"], r["route_id"]] == r["raw_rank"]


def test_same_answer_for_equal_preferences(spark):
    prefs = spark.createDataFrame([{**BASE_P, "pref_id": i} for i in range(50)], PREF)
    routes = spark.createDataFrame([{**BASE_R, "route_id": i, "miles": 30.0 + i} for i in range(5)], ROUTE)
    scored = scoring.score_routes(prefs, routes)
    assert scored.count() == 5
    every = scoring.per_traveller(prefs, scored)
    assert every.count() == 250
    assert every.groupBy("route_id").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0


def test_one_bad_traveller_among_good_ones(spark):
    """No days or no miles a day: no score and no picks for that traveller, and none lost for the others."""
    people = [BASE_P, {**BASE_P, "pref_id": 2, "days": 0}, {**BASE_P, "pref_id": 3, "miles_per_day": 0.0}]
    prefs, routes = spark.createDataFrame(people, PREF), spark.createDataFrame([BASE_R, {**BASE_R, "route_id": 2, "center_lat": 38.9}], ROUTE)
    scored = scoring.per_traveller(prefs, scoring.score_routes(prefs, routes))
    told = {(r["pref_id"], r["route_id"]): r["score"] for r in scored.collect()}
    assert len(told) == 6 and all((score is None) == (who != 1) for (who, _), score in told.items())
    picks = ranking.diverse_top(scored, key="pref_id").select("pref_id").collect()
    assert [r[0] for r in picks] == [1, 1]
