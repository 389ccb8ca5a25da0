"""Positions and joins where one key holds most rows."""

from pyspark.sql import Window, functions as F

from cairn.operators import elevation, scoring
from cairn.operators.ordering import numbered, short_key, spread_join


def skewed(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 7).alias("k"),
        F.xxhash64("id").alias("v"),
        "id",
    )


def test_positions_equal_a_window(spark):
    df = skewed(spark)
    got = numbered(df, ["k"], F.shiftright("v", 56), [F.col("v"), F.col("id")])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    assert got.join(want.select("id", "want"), "id").filter("pos <> want").isEmpty()
    assert got.count() == 3000


def test_spread_join_equals_a_join(spark):
    few = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    few = few.unionByName(few.withColumn("w", F.col("w") + 1))
    got = spread_join(skewed(spark), few, ["k"], "id")
    want = skewed(spark).join(few, "k")
    assert got.count() == want.count() == 6000
    assert got.select("id", "w").exceptAll(want.select("id", "w")).isEmpty()


def test_spread_join_sends_no_repeated_side_through_the_driver(spark):
    """A side that is small before its repeats was broadcast with all of them."""
    few = spark.range(7).select(F.col("id").alias("k"), F.col("id").alias("w"))
    plan = spread_join(skewed(spark), few, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_chunks_do_not_change_a_series(spark):
    series = spark.range(500).select(F.lit(1).alias("s"), F.col("id").alias("pos"), (F.xxhash64("id") % 100).cast("double").alias("elev_ft"))
    whole = {r["pos"]: r["smooth_ft"] for r in elevation.smooth(series, ["s"], chunk=10**6).collect()}
    cut = {r["pos"]: r["smooth_ft"] for r in elevation.smooth(series, ["s"], chunk=7).collect()}
    assert whole == cut and len(whole) == 500
    gains = [elevation.gain_loss(elevation.smooth(series, ["s"], chunk=c), ["s"]).first() for c in (7, 10**6)]
    assert gains[0] == gains[1]


def test_short_keys_differ_and_are_short(spark):
    keys = spark.range(20000).select(short_key(F.col("id").cast("string")).alias("k"))
    assert keys.distinct().count() == 20000 and {len(r.k) for r in keys.limit(50).collect()} == {16}
    want = {"region_id": 1, "days": 3, "miles_per_day": 8.0, "tolerance": "any", "scenery": ["lakes"], "crowd": "mixed"}
    made = spark.createDataFrame([want], "region_id long, days int, miles_per_day double, tolerance string, scenery array<string>, crowd string")
    assert len(made.select(scoring.profile_key()).first()[0]) == 16
