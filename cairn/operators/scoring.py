"""Fit of a route to a traveller's preferences: six parts and a weighted total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.geo import half_up
from cairn.operators.ordering import short_key, spread_join

# Daily gain bands (centre, half width), slack beyond a band, weights.
BANDS = {"easy": (750.0, 750.0), "moderate": (2250.0, 750.0), "hard": (3750.0, 1000.0)}
BAND_SLACK_FT = 1500.0
WEIGHTS = {
    "mileage_fit": 25,
    "elevation_fit": 20,
    "scenery_match": 20,
    "crowd_match": 15,
    "accessibility": 10,
    "feature_density": 10,
}
# Feature types that answer a scenery word.
SCENERY_TYPES = {
    "lakes": ["lake", "water", "reservoir"],
    "peaks": ["peak"],
    "passes": ["saddle", "pass"],
    "waterfalls": ["waterfall"],
}
PREF_COLUMNS = ["days", "miles_per_day", "tolerance", "scenery", "crowd"]


def _clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def mileage_fit(miles: Column, days: Column, target: Column) -> Column:
    off = F.try_divide(F.abs(F.try_divide(miles, days) - target), target)
    return half_up(_clamp(100.0 - off * 200.0))


def _band(tolerance: Column, part: int) -> Column:
    return (
        F.when(tolerance == "easy", BANDS["easy"][part])
        .when(tolerance == "hard", BANDS["hard"][part])
        .otherwise(BANDS["moderate"][part])
    )


def elevation_fit(gain_ft: Column, days: Column, tolerance: Column) -> Column:
    away = F.abs(F.try_divide(gain_ft, days) - _band(tolerance, 0)) / (_band(tolerance, 1) + BAND_SLACK_FT)
    return half_up(100.0 * F.when(away.isNotNull(), F.greatest(F.lit(0.0), 1.0 - away * away)))


def scenery_counts(types: Column) -> Column:
    """Features per scenery word, computed once per route before any pairing."""

    def count(wanted: list[str]) -> Column:
        return F.size(F.filter(types, lambda t: t.isin(wanted)))

    return F.struct(*[count(wanted).alias(word) for word, wanted in SCENERY_TYPES.items()])


def scenery_match(
    scenery: Column, counts: Column, ht_ratio: Column, peaks: Column, passes: Column, gain_ft: Column, days: Column
) -> Column:
    """Share of wanted scenery at hand (80 points) plus up to 15 per word for plenty."""

    def found(word: Column) -> Column:
        out = F.when(word == "forest", F.when(ht_ratio < 0.2, 1).otherwise(0)).when(
            word == "alpine",
            F.when(((peaks > 0) | (passes > 0)) & (F.try_divide(gain_ft, days) > 2000), 1).otherwise(0),
        )
        for known in SCENERY_TYPES:
            out = out.when(word == known, counts[known])
        return out.otherwise(0)

    hits = F.transform(scenery, found)
    matched = F.size(F.filter(hits, lambda n: n > 0))
    plenty = F.aggregate(
        hits,
        F.lit(0),
        lambda acc, n: acc + F.when(n > 1, F.least(F.lit(15), (n - 1) * 5)).otherwise(0),
    )
    return F.when(F.coalesce(F.size(scenery), F.lit(0)) <= 0, F.lit(50).cast("long")).otherwise(
        half_up(F.least(F.lit(100.0), matched / F.size(scenery) * 80.0 + plenty))
    )


def crowd_match(crowd: Column, ht_ratio: Column) -> Column:
    busy = F.least(F.lit(70.0), ht_ratio / 0.5 * 70.0)
    mixed = F.greatest(F.lit(60.0), 100.0 - F.abs(ht_ratio - 0.25) / 0.35 * 40.0)
    return half_up(
        _clamp(
            F.when(crowd == "popular", 30.0 + busy).when(crowd == "solitude", 100.0 - busy).otherwise(mixed)
        )
    )


def accessibility(trailheads: Column) -> Column:
    count = F.when(F.coalesce(trailheads, F.lit(0)) == 0, 1).otherwise(trailheads)
    return F.least(F.lit(100), count * 20).cast("long")


def feature_density(feature_count: Column, miles: Column) -> Column:
    per_mile = feature_count / F.greatest(F.lit(1.0), miles)
    return half_up(F.least(F.lit(1.0), per_mile / 0.6) * 100.0)


def total_score() -> Column:
    """Weighted sum of the rounded parts, over the part columns of :func:`with_scores`."""
    points = sum(
        (F.col(part) / 100.0 * weight for part, weight in WEIGHTS.items()), start=F.lit(0.0)
    )
    return half_up(points / sum(WEIGHTS.values()) * 100.0)


def with_scores(pairs: DataFrame) -> DataFrame:
    """Add the six parts and ``score`` to rows that hold a route and preferences."""
    c = F.col
    return pairs.select(
        "*",
        mileage_fit(c("miles"), c("days"), c("miles_per_day")).alias("mileage_fit"),
        elevation_fit(c("gain_ft"), c("days"), c("tolerance")).alias("elevation_fit"),
        scenery_match(
            c("scenery"), c("counts"), c("ht_ratio"), c("distinct_peaks"), c("distinct_passes"), c("gain_ft"), c("days")
        ).alias("scenery_match"),
        crowd_match(c("crowd"), c("ht_ratio")).alias("crowd_match"),
        accessibility(c("trailhead_count")).alias("accessibility"),
        feature_density(c("feature_count"), c("miles")).alias("feature_density"),
    ).withColumn("score", total_score())


def profile_key() -> Column:
    """One key for travellers of a region who want the same thing."""
    return short_key(F.to_json(F.struct("region_id", *PREF_COLUMNS)))


def profiles(prefs: DataFrame) -> DataFrame:
    return (
        prefs.withColumn("profile", profile_key())
        .groupBy("profile")
        .agg(*[F.first(x).alias(x) for x in ["region_id", *PREF_COLUMNS]])
    )


def score_routes(prefs: DataFrame, routes: DataFrame) -> DataFrame:
    """Every route of a region scored for every distinct profile of that region.

    Equal preferences are scored once. The join is salted by route, so a region
    that holds much of the data is spread over many tasks.
    """
    slim = routes.withColumn("counts", scenery_counts(F.col("feature_types"))).drop("feature_types")
    return with_scores(spread_join(slim, profiles(prefs), ["region_id"], "route_id"))


def per_traveller(prefs: DataFrame, scored: DataFrame, few: bool = False) -> DataFrame:
    """Scored rows of each traveller's profile.

    ``few`` tells that a profile has a handful of rows (picks); then the
    travellers are salted, since many may share one profile.
    """
    who = prefs.select("pref_id", profile_key().alias("profile"))
    if few:
        return spread_join(who, scored, ["profile"], "pref_id")
    return spread_join(scored, who, ["profile"], "route_id")
