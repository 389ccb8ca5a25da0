"""Loop identity, signals and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.geo import round_to
from cairn.operators.ordering import short_key
from cairn.session import Stages

# Trails counted as high traffic, feature types per category.
HIGH_TRAFFIC = [
    "John Muir Trail",
    "Pacific Crest Trail",
    "Continental Divide Trail",
    "Appalachian Trail",
]
PASS_TYPES = ["saddle", "pass"]
LAKE_TYPES = ["lake", "water", "reservoir"]
PEAK_TYPES = ["peak"]
SIMILARITY = 0.60
COORDS_PER_SEGMENT = 20
UNNAMED = "(unnamed)"


# --- identity --------------------------------------------------------------


def fingerprint(seg_ids: Column) -> Column:
    """Segments with their number of uses, ``3x1|7x2``, in id order."""
    uses = F.transform(
        F.array_sort(F.array_distinct(seg_ids)),
        lambda s: F.concat(
            s.cast("string"), F.lit("x"), F.size(F.filter(seg_ids, lambda o: o == s)).cast("string")
        ),
    )
    return F.array_join(uses, "|")


def unique_loops(walks: DataFrame) -> DataFrame:
    """The shortest walk per fingerprint; equal miles go to the first in search order."""
    seg_ids = F.transform("path", lambda d: F.shiftright(d, 1))
    return (
        walks.withColumn("print", fingerprint(seg_ids))
        .groupBy("region_id", "print")
        .agg(
            F.min_by(
                F.struct("anchor", "miles", "path"), F.struct(round_to(F.col("miles"), 6), "anchor", "path")
            ).alias("w")
        )
        .select("region_id", F.sha1("print").alias("loop_id"), "print", "w.*")
    )


def loop_steps(loops: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per step of a loop with its segment and its direction."""
    step = loops.select("region_id", "loop_id", F.posexplode("path").alias("step", "dir_id"))
    return step.withColumn("seg_id", F.shiftright("dir_id", 1)).join(
        segments, ["region_id", "seg_id"]
    ).withColumn("forward", F.col("dir_id") % 2 == 0)


# --- signals ---------------------------------------------------------------


def directed_gain(forward: Column, gain: Column, loss: Column) -> Column:
    return F.coalesce(F.when(forward, gain).otherwise(loss), F.lit(0))


def loop_climb(steps: DataFrame) -> DataFrame:
    up = directed_gain(F.col("forward"), F.col("gain_ft"), F.col("loss_ft"))
    down = directed_gain(F.col("forward"), F.col("loss_ft"), F.col("gain_ft"))
    return steps.groupBy("region_id", "loop_id").agg(
        F.sum(up).alias("total_gain_ft"), F.sum(down).alias("total_loss_ft")
    )


def trail_names(steps: DataFrame) -> DataFrame:
    """Sorted distinct names per loop and their number."""
    named = F.when(F.length("name") > 0, F.col("name"))
    return steps.groupBy("region_id", "loop_id").agg(
        F.array_sort(F.collect_set(named)).alias("distinct_trails"),
        F.count_distinct(named).alias("distinct_trail_count"),
    )


def trail_route(steps: DataFrame) -> DataFrame:
    """Names along the loop with runs of one name written once."""
    along = Window.partitionBy("region_id", "loop_id").orderBy("step")
    label = F.when(F.length("name") > 0, F.col("name")).otherwise(UNNAMED)
    previous = F.lag("label").over(along)
    return (
        steps.withColumn("label", label)
        .withColumn("turn", previous.isNull() | (previous != F.col("label")))
        .filter("turn")
        .groupBy("region_id", "loop_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("step", "label"))), lambda s: s["label"]
            ).alias("trail_route")
        )
    )


def feature_pool(peaks: Column, passes: Column, springs: Column, landmarks: Column, lakes: Column, streams: Column) -> Column:
    """All features of a segment in one array, with the key they are counted by."""
    def keyed(features: Column, kind: str) -> Column:
        return F.transform(
            F.coalesce(features, F.array().cast("array<struct<id:bigint,name:string,type:string,dist_mi:double>>")),
            lambda f: F.struct(feature_key(F.lit(kind), f["id"], f["name"]).alias("key"), f["name"].alias("name"), f["type"].alias("type")),
        )

    return F.concat(
        keyed(peaks, "node"),
        keyed(passes, "node"),
        keyed(springs, "node"),
        keyed(landmarks, "node"),
        keyed(lakes, "way"),
        keyed(streams, "stream"),
    )


def feature_key(kind: Column, feature_id: Column, name: Column) -> Column:
    """Streams count once per name, nodes and lakes once per id."""
    return F.when(kind == "stream", F.concat(F.lit("stream:"), name)).otherwise(
        F.concat(kind, F.lit(":"), feature_id.cast("string"))
    )


def loop_features(step_features: DataFrame) -> DataFrame:
    """Distinct named features per loop. ``step_features``: region_id, loop_id, key, name, type."""
    return (
        step_features.filter("length(name) > 0")
        .groupBy("region_id", "loop_id", "key")
        .agg(F.min(F.struct("name", "type")).alias("f"))
        .select("region_id", "loop_id", "key", "f.*")
    )


def feature_counts(features: DataFrame) -> DataFrame:
    """Number of features and of distinct names in three categories, per loop."""

    def distinct(types: list[str]) -> Column:
        return F.count_distinct(F.when(F.col("type").isin(types), F.col("name")))

    return features.groupBy("region_id", "loop_id").agg(
        F.count(F.lit(1)).alias("feature_count"),
        distinct(PASS_TYPES).alias("distinct_passes"),
        distinct(LAKE_TYPES).alias("distinct_lakes"),
        distinct(PEAK_TYPES).alias("distinct_peaks"),
    )


def feature_list(features: DataFrame) -> DataFrame:
    def names(types: list[str]) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("type").isin(types), F.col("name"))))

    return features.groupBy("region_id", "loop_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "type"))).alias("features"),
        names(PASS_TYPES).alias("pass_names"),
        names(PEAK_TYPES).alias("peak_names"),
    )


def traffic_ratio(steps: DataFrame) -> DataFrame:
    """Share of miles on high-traffic trails, zero for a loop of no length."""
    busy = F.sum(F.when(F.col("name").isin(HIGH_TRAFFIC), F.col("length_mi")).otherwise(0.0))
    total = F.sum("length_mi")
    return steps.groupBy("region_id", "loop_id").agg(
        F.when(total > 0, busy / total).otherwise(0.0).alias("ht_ratio")
    )


def centroid(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean position of the distinct junctions of a loop."""
    spots = (
        steps.select("region_id", "loop_id", F.explode(F.array("start_node", "end_node")).alias("node_id"))
        .distinct()
        .join(nodes.select("region_id", "node_id", "lat", "lon"), ["region_id", "node_id"])
    )
    return spots.groupBy("region_id", "loop_id").agg(
        F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon")
    )


def top_trail(steps: DataFrame) -> DataFrame:
    """Name with the most miles on a loop; equal miles go to the first name."""
    miles = (
        steps.filter("length(name) > 0")
        .groupBy("region_id", "loop_id", "name")
        .agg(F.sum("length_mi").alias("miles"))
    )
    return miles.groupBy("region_id", "loop_id").agg(
        F.min_by("name", F.struct(-round_to(F.col("miles"), 6), "name")).alias("top_trail")
    )


def junction_labels(segments: DataFrame, trailheads: DataFrame, shown: int = 3) -> DataFrame:
    """Trailhead name, else the first trail names that meet there, else the id."""
    met = segments.filter("length(name) > 0").select(
        "region_id", "seg_id", "name", F.explode(F.array("start_node", "end_node")).alias("node_id")
    )
    first_met = met.groupBy("region_id", "node_id", "name").agg(F.min("seg_id").alias("seg_id"))
    in_order = Window.partitionBy("region_id", "node_id").orderBy("seg_id", "name")
    crossing = (
        first_met.withColumn("place", F.row_number().over(in_order))
        .filter(F.col("place") <= shown)
        .groupBy("region_id", "node_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
        .select(
            "region_id", "node_id", F.array_join(F.transform("n", lambda x: x["name"]), " / ").alias("names")
        )
    )
    every = segments.select(
        "region_id", F.explode(F.array("start_node", "end_node")).alias("node_id")
    ).distinct()
    heads = (
        trailheads.filter("length(name) > 0")
        .groupBy("region_id", "node_id")
        .agg(F.max("name").alias("head_name"))
    )
    return (
        every.join(crossing, ["region_id", "node_id"], "left")
        .join(heads, ["region_id", "node_id"], "left")
        .select(
            "region_id",
            "node_id",
            F.coalesce(
                F.col("head_name"),
                F.concat(F.lit("jct ("), F.col("names"), F.lit(")")),
                F.concat(F.lit("junction "), F.col("node_id").cast("string")),
            ).alias("label"),
        )
    )


# --- overlap and families --------------------------------------------------


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two distinct arrays, zero for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlapping_pairs(sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs of one region with an overlap above ``threshold``.

    ``sets``: region_id, set_id, items (distinct). Two sets that overlap that
    much must share one of their rarest items, so only a short prefix of each
    set, rarest first, is joined; sizes are compared in the same join, and a
    pair is tested once, at its first common prefix item.
    """
    tokens = sets.select("region_id", "set_id", F.explode("items").alias("item"))
    rarity = tokens.groupBy("region_id", "item").agg(F.count(F.lit(1)).alias("uses"))
    ranked = (
        tokens.join(rarity, ["region_id", "item"])
        .groupBy("region_id", "set_id")
        .agg(F.array_sort(F.collect_list(F.struct("uses", "item"))).alias("r"))
        .select("region_id", "set_id", F.transform("r", lambda x: x["item"]).alias("items"))
        .withColumn("n", F.size("items"))
    )
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefixed = ranked.withColumn("prefix", F.slice("items", F.lit(1), keep.cast("int")))
    side = prefixed.select("*", F.explode("prefix").alias("item"))

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            "region_id",
            "item",
            F.col("set_id").alias(tag),
            F.col("n").alias(f"{tag}_n"),
            F.col("items").alias(f"{tag}_items"),
            F.col("prefix").alias(f"{tag}_prefix"),
        )

    both = F.size(F.array_intersect("a_items", "b_items"))
    return (
        named(side, "a")
        .join(named(side, "b"), ["region_id", "item"])
        .filter("a < b")
        .filter(
            (F.col("a_n") >= F.col("b_n") * threshold) & (F.col("b_n") >= F.col("a_n") * threshold)
        )
        .filter(F.element_at(F.array_intersect("a_prefix", "b_prefix"), 1) == F.col("item"))
        .withColumn("shared", both)
        .withColumn("overlap", F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared")))
        .filter(F.col("overlap") > threshold)
        .select("region_id", "a", "b", "shared", "overlap")
    )


def loop_families(loops: DataFrame, threshold: float = SIMILARITY, max_rounds: int = 10000) -> DataFrame:
    """``region_id, loop_id, leader_id``: loops gathered around the best loop they overlap.

    ``loops``: region_id, loop_id, seg_ids, rank (orderable, unique; least is
    best). Walking loops from best to worst, a loop that overlaps no earlier
    leader becomes one; others join the best leader they overlap. Each round
    settles every loop whose better rivals are settled, which gives the same
    families as the walk. Loops over the very same segments behave alike, so
    only the best of each such group takes part.
    """
    stages = Stages(loops.sparkSession)
    marked = loops.withColumn("items", F.array_sort(F.array_distinct("seg_ids"))).withColumn(
        "set_id", short_key(F.array_join("items", ","))
    )
    distinct = marked.groupBy("region_id", "set_id").agg(
        F.first("items").alias("items"), F.min_by("loop_id", "rank").alias("loop_id"), F.min("rank").alias("rank")
    )
    sets = stages.cut(distinct)
    ranks = sets.select("region_id", "set_id", "rank")
    rivals = stages.cut(
        overlapping_pairs(sets, threshold)
        .join(ranks.withColumnsRenamed({"set_id": "a", "rank": "a_rank"}), ["region_id", "a"])
        .join(ranks.withColumnsRenamed({"set_id": "b", "rank": "b_rank"}), ["region_id", "b"])
        .select(
            "region_id",
            F.when(F.col("a_rank") < F.col("b_rank"), F.col("a")).otherwise(F.col("b")).alias("better"),
            F.when(F.col("a_rank") < F.col("b_rank"), F.col("b")).otherwise(F.col("a")).alias("set_id"),
            F.least("a_rank", "b_rank").alias("better_rank"),
        )
    )
    state = stages.cut(sets.select("region_id", "set_id", F.lit("open").alias("status")))
    for _ in range(max_rounds):
        seen = (
            rivals.join(
                state.withColumnsRenamed({"set_id": "better", "status": "better_status"}),
                ["region_id", "better"],
            )
            .groupBy("region_id", "set_id")
            .agg(
                F.bool_or(F.col("better_status") == "leader").alias("led"),
                F.bool_or(F.col("better_status") == "open").alias("blocked"),
            )
        )
        state = stages.cut(
            state.join(seen, ["region_id", "set_id"], "left").select(
                "region_id",
                "set_id",
                F.when(F.col("status") != "open", F.col("status"))
                .when(F.col("led"), "member")
                .when(F.col("blocked"), "open")
                .otherwise("leader")
                .alias("status"),
            ),
            "status = 'open'",
        )
        if not stages.seen["status = 'open'"]:
            break
    else:
        raise RuntimeError(f"families not settled after {max_rounds} rounds")

    leaders = state.filter("status = 'leader'").select("region_id", "set_id")
    joined = (
        rivals.join(leaders.withColumnRenamed("set_id", "better"), ["region_id", "better"], "left_semi")
        .join(state.filter("status = 'member'"), ["region_id", "set_id"], "left_semi")
        .groupBy("region_id", "set_id")
        .agg(F.min_by("better", "better_rank").alias("leader_set"))
    )
    assigned = joined.unionByName(leaders.withColumn("leader_set", F.col("set_id")))
    best_of = sets.select(
        "region_id", F.col("set_id").alias("leader_set"), F.col("loop_id").alias("leader_id")
    )
    return (
        marked.select("region_id", "set_id", "loop_id")
        .join(assigned, ["region_id", "set_id"])
        .join(best_of, ["region_id", "leader_set"])
        .select("region_id", "loop_id", "leader_id")
    )


def family_size(families: DataFrame, starts: DataFrame) -> DataFrame:
    """Members and distinct start labels per leader. ``starts``: region_id, loop_id, start."""
    return (
        families.join(starts, ["region_id", "loop_id"])
        .groupBy("region_id", F.col("leader_id").alias("loop_id"))
        .agg(
            F.count(F.lit(1)).alias("cluster_size"), F.count_distinct("start").alias("trailhead_count")
        )
    )


# --- geometry --------------------------------------------------------------


def midpoint(node_ids: Column) -> Column:
    return F.get(node_ids, F.floor(F.size(node_ids) / 2).cast("int"))


def sampled(items: Column, count: int = COORDS_PER_SEGMENT) -> Column:
    """Every n-th item, n such that about ``count`` remain, and always the last item."""
    step = F.greatest(F.lit(1), F.floor(F.size(items) / count).cast("int"))
    last = F.size(items) - 1
    return F.filter(items, lambda _, i: (i % step == 0) | (i == last))


def sample_rows(rows: DataFrame, keys: list[str], count: int = COORDS_PER_SEGMENT) -> DataFrame:
    """The same choice over rows (keys, pos), for series too long to hold in an array."""
    size = rows.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / count))
    return rows.join(size, keys).filter(
        (F.col("pos") % step == 0) | (F.col("pos") == F.col("_n") - 1)
    ).drop("_n")
