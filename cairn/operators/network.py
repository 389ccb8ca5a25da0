"""From map elements to a segment graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.geo import haversine_miles, round_to

# Words that mark a peak-tagged node as a terrain feature, not a summit.
NOT_A_SUMMIT = r"(?i)stairway|stairs|gap|notch|chute|steps?(?:\s|$)|bench|ledge|shelf|ramp"
# Miles and degrees.
SHORTEST_SEGMENT_MI = 0.001
BOUNDARY_DEG = 0.005
WAY_PIECES = 10_000  # numbers kept for the pieces of one way


# --- classification -------------------------------------------------------


def misnamed_peak(name: Column) -> Column:
    return name.rlike(NOT_A_SUMMIT)


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_trail(tags: Column) -> Column:
    return (
        _true(tags["highway"].isin("path", "footway"))
        | _true(tags["route"] == "hiking")
        | _true(tags["sac_scale"] != "")
    )


def feature_type(tags: Column) -> Column:
    return F.coalesce(
        tags["natural"], F.when(tags["mountain_pass"] == "yes", "pass").otherwise("feature")
    )


def water_type(tags: Column) -> Column:
    return F.coalesce(tags["water"], tags["waterway"], tags["natural"], F.lit("water"))


def node_classes(tags: Column) -> Column:
    """The classes of a node; a node may have several."""

    def filled(key: str) -> Column:
        return _true(F.length(tags[key]) > 0)

    def tagged(key: str, value: str) -> Column:
        return _true(tags[key] == value)

    named = filled("name")
    summit = tagged("natural", "peak") & named
    misnamed = _true(misnamed_peak(tags["name"]))
    landmark = (
        (summit & misnamed)
        | tagged("natural", "waterfall")
        | tagged("tourism", "viewpoint")
        | (
            named
            & (
                tagged("natural", "cliff")
                | tagged("tourism", "attraction")
                | tagged("place", "locality")
                | filled("historic")
                | filled("geological")
            )
        )
    )
    classes = F.array(
        F.when(tagged("highway", "trailhead") | tagged("information", "trailhead"), "trailhead"),
        F.when(summit & ~misnamed, "peak"),
        F.when(tagged("mountain_pass", "yes") | tagged("natural", "saddle"), "pass"),
        F.when(tagged("natural", "spring"), "spring"),
        F.when(landmark, "landmark"),
    )
    return F.filter(classes, lambda c: c.isNotNull())


def way_class(tags: Column) -> Column:
    return (
        F.when(is_trail(tags), "trail")
        .when(tags["waterway"].isin("stream", "river"), "stream")
        .when(tags["natural"] == "water", "lake")
    )


def classify(elements: DataFrame) -> DataFrame:
    """One row per (element, class): the five node classes and three way classes."""
    tags = F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    classes = F.when(F.col("type") == "node", node_classes(tags)).otherwise(
        F.filter(F.array(way_class(tags)), lambda c: c.isNotNull())
    )
    return elements.withColumn("tags", tags).withColumn("class", F.explode(classes))


def node_index(elements: DataFrame) -> DataFrame:
    """Last coordinates per node id; tags stay those of the last tagged row."""
    tagged = F.size(F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))) > 0
    where = F.max_by(F.struct("lat", "lon"), "pos")
    return (
        elements.filter(F.col("type") == "node")
        .groupBy("region_id", F.col("id").alias("node_id"))
        .agg(where.alias("at"), F.max(F.when(tagged, F.col("pos"))).alias("tag_pos"))
        .select("region_id", "node_id", "at.lat", "at.lon", "tag_pos")
    )


def extract(elements: DataFrame, bbox: DataFrame) -> DataFrame:
    """Elements of the tag clauses inside their region's box, plus member nodes of kept ways.

    ``bbox`` has one row per region: ``region_id, min_lat, min_lon, max_lat, max_lon``.
    """
    t = F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    named = t["name"].isNotNull()
    node_clause = (
        (t["highway"] == "trailhead")
        | (t["information"] == "trailhead")
        | ((t["amenity"] == "parking") & (t["hiking"] == "yes"))
        | (t["natural"].isin("spring", "saddle", "waterfall"))
        | (t["natural"].isin("peak", "cliff") & named)
        | (t["mountain_pass"] == "yes")
        | (t["tourism"] == "viewpoint")
        | ((t["tourism"] == "attraction") & named)
        | (t["historic"].isNotNull() & named)
        | (t["geological"].isNotNull() & named)
        | ((t["place"] == "locality") & named)
    )
    way_clause = (
        ((t["highway"] == "path") & (named | t["sac_scale"].isNotNull()))
        | ((t["highway"] == "footway") & named)
        | (t["route"] == "hiking")
        | t["waterway"].isin("stream", "river")
        | (t["natural"] == "water")
    )
    nodes = elements.filter(F.col("type") == "node").join(bbox, "region_id").withColumn(
        "inside",
        F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
        & F.col("lon").between(F.col("min_lon"), F.col("max_lon")),
    )
    ways = elements.filter((F.col("type") == "way") & way_clause)
    members = ways.select("region_id", F.col("id").alias("way_id"), F.explode("nodes").alias("id"))
    # a way is kept when at least one of its vertices lies in the box
    touching = (
        members.join(nodes.filter("inside").select("region_id", "id"), ["region_id", "id"], "left_semi")
        .select("region_id", F.col("way_id").alias("id"))
        .distinct()
    )
    kept_ways = ways.join(touching, ["region_id", "id"], "left_semi")
    kept_members = (
        members.join(
            touching.withColumnRenamed("id", "way_id"), ["region_id", "way_id"], "left_semi"
        )
        .select("region_id", "id")
        .distinct()
        .withColumn("member", F.lit(True))
    )
    kept_nodes = (
        nodes.join(kept_members, ["region_id", "id"], "left")
        .filter((F.col("inside") & F.coalesce(node_clause, F.lit(False))) | F.col("member"))
        .select(*elements.columns)
    )
    return kept_nodes.unionByName(kept_ways.select(*elements.columns))


# --- junctions and segments ----------------------------------------------


def way_vertices(ways: DataFrame) -> DataFrame:
    return ways.select(
        "region_id", F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node_id")
    )


def node_usage(vertices: DataFrame) -> DataFrame:
    """Distinct ways per node."""
    return vertices.groupBy("region_id", "node_id").agg(
        F.count_distinct("way_id").alias("way_count")
    )


def way_ends(vertices: DataFrame) -> DataFrame:
    ends = vertices.groupBy("region_id", "way_id").agg(
        F.min_by("node_id", "pos").alias("first"), F.max_by("node_id", "pos").alias("last")
    )
    return ends.select("region_id", F.explode(F.array("first", "last")).alias("node_id"))


def junctions(vertices: DataFrame, trailheads: DataFrame) -> DataFrame:
    """Nodes of two or more ways, trailheads, and way ends."""
    key = ["region_id", "node_id"]
    sure = trailheads.select(*key).unionByName(way_ends(vertices)).withColumns({"way_id": F.lit(None), "sure": F.lit(True)})
    return (
        vertices.select(*key, "way_id", F.lit(False).alias("sure"))
        .unionByName(sure)
        .groupBy(*key)
        .agg(F.min("way_id").alias("first"), F.max("way_id").alias("last"), F.max("sure").alias("sure"))
        .filter("sure or first <> last")
        .select(*key)
    )


def split_ways(vertices: DataFrame, junction_nodes: DataFrame) -> DataFrame:
    """Cut ways at interior junctions; the cut vertex belongs to both sides.

    Adds ``sub``, the number of the piece within its way. Windows run per way: a
    way arrives as one array in one input row, so it is bounded by its source.
    Coordinates that are already there are carried along.
    """
    marked = vertices.join(
        junction_nodes.select("region_id", "node_id").distinct().withColumn("is_junction", F.lit(1)),
        ["region_id", "node_id"],
        "left",
    )
    # one order for all windows of a way, so its rows are sorted once
    along = Window.partitionBy("region_id", "way_id").orderBy("pos")
    before, every = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = F.when(
        F.col("is_junction").isNotNull() & (F.col("pos") > 0) & (F.col("pos") < F.col("last_pos")), 1
    ).otherwise(0)
    return (
        marked.withColumn("last_pos", F.max("pos").over(every))
        .withColumn("cut", cut)
        .withColumn("sub", F.coalesce(F.sum("cut").over(before), F.lit(0)))
        .withColumn(
            "sub",
            F.explode(
                F.when(F.col("cut") == 1, F.array(F.col("sub"), F.col("sub") + 1)).otherwise(
                    F.array("sub")
                )
            ),
        )
        .filter("last_pos > 0")
        .select("region_id", "way_id", "sub", "pos", "node_id", *[c for c in ("lat", "lon") if c in vertices.columns])
    )


def polyline_miles(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of consecutive distances; a step with a missing end adds nothing."""
    along = Window.partitionBy(*keys).orderBy("pos")
    step = haversine_miles(
        F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon")
    )
    return (
        points.withColumn("step", step)
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("miles"))
    )


def bounding_box(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def located(vertices: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices with coordinates, null where the node is unknown."""
    return vertices.join(
        nodes.select("region_id", "node_id", "lat", "lon"), ["region_id", "node_id"], "left"
    )


def drop_short(segments: DataFrame, miles: str = "miles", shortest: float = SHORTEST_SEGMENT_MI) -> DataFrame:
    return segments.filter(F.col(miles) >= shortest)


def assemble(points: DataFrame) -> DataFrame:
    """One row per piece with ordered node ids and exact miles.

    ``points``: located vertices of :func:`split_ways`. Rows of a way are
    together already, so steps and sums need no further shuffle.
    """
    keys = ["region_id", "way_id", "sub"]
    along = Window.partitionBy(*keys).orderBy("pos")
    step = haversine_miles(
        F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon")
    )
    return (
        points.withColumn("step", step)
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("v"),
            F.coalesce(F.sum("step"), F.lit(0.0)).alias("miles"),
        )
        .select(*keys, F.transform("v", lambda x: x["node_id"]).alias("node_ids"), "miles")
    )


def segments_from(subs: DataFrame, way_info: DataFrame) -> DataFrame:
    """Final segment rows: short ones dropped, ends named, length at three decimals.

    ``seg_id`` packs (place of the way in its source, piece), so it keeps the
    discovery order of segments without a global sort.
    """
    return (
        drop_short(subs)
        .select("region_id", "way_id", "sub", "node_ids", "miles")
        .join(way_info.select("region_id", "way_id", "way_no", "name", "sac_scale"), ["region_id", "way_id"])
        .select(
            "region_id",
            piece_id(F.col("way_no"), F.col("sub")).alias("seg_id"),
            "way_id",
            "sub",
            "name",
            "sac_scale",
            F.element_at("node_ids", 1).alias("start_node"),
            F.element_at("node_ids", -1).alias("end_node"),
            "node_ids",
            F.size("node_ids").alias("node_count"),
            round_to(F.col("miles"), 3).alias("length_mi"),
        )
    )


def segment_ends(segments: DataFrame) -> DataFrame:
    """Both ends of every segment; a self-loop counts twice."""
    return segments.select(
        "*", F.explode(F.array("start_node", "end_node")).alias("node_id")
    )


def degree(segments: DataFrame) -> DataFrame:
    return (
        segment_ends(segments)
        .groupBy("region_id", "node_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def piece_id(way_no: Column, sub: Column) -> Column:
    """Number of a way's piece; a way with more pieces than fit ends the job instead of taking its neighbour's numbers."""
    return F.when(sub < WAY_PIECES, way_no * WAY_PIECES + sub).otherwise(
        F.raise_error(F.lit(f"a way has {WAY_PIECES} pieces or more")).cast("long")
    )


def boundary_nodes(segments: DataFrame, nodes: DataFrame, bbox: DataFrame, tolerance: float = BOUNDARY_DEG) -> DataFrame:
    """Dead ends close to an edge of the query box of their region."""
    gap = F.least(
        F.abs(F.col("lat") - F.col("min_lat")),
        F.abs(F.col("lat") - F.col("max_lat")),
        F.abs(F.col("lon") - F.col("min_lon")),
        F.abs(F.col("lon") - F.col("max_lon")),
    )
    return (
        degree(segments)
        .filter("degree = 1")
        .join(nodes.select("region_id", "node_id", "lat", "lon"), ["region_id", "node_id"])
        .join(bbox, "region_id")
        .filter(gap < tolerance)
        .select("region_id", "node_id")
    )


def summarize(segments: DataFrame, junction_nodes: DataFrame, component_sizes: DataFrame) -> DataFrame:
    """Counts, miles and connectivity per region, with a total row (null region)."""
    named = F.length(F.coalesce(F.col("name"), F.lit(""))) > 0
    # lengths have three decimals: summed as whole thousandths, order does not matter
    milli = F.floor(F.col("length_mi") * 1000 + 0.5)
    pct = F.floor(F.col("named_miles") / F.nullif(F.col("total_miles"), F.lit(0.0)) * 100 + 0.5)
    lines = (
        segments.rollup("region_id")
        .agg(
            F.count(F.lit(1)).alias("segments"),
            F.count_if(named).alias("named_segments"),
            F.count_distinct(F.when(named, F.col("name"))).alias("trail_names"),
            (F.sum(milli) / 1000.0).alias("total_miles"),
            (F.coalesce(F.sum(F.when(named, milli)), F.lit(0)) / 1000.0).alias("named_miles"),
        )
        .withColumn("named_pct", pct.cast("long"))
        .withColumn("total_miles", round_to(F.col("total_miles"), 1))
        .withColumn("named_miles", round_to(F.col("named_miles"), 1))
    )
    spots = junction_nodes.rollup("region_id").agg(F.count(F.lit(1)).alias("junctions"))
    parts = component_sizes.rollup("region_id").agg(
        F.count(F.lit(1)).alias("components"), F.max("size").alias("largest_component")
    )
    share = F.floor(F.col("largest_component") / F.col("junctions") * 100 + 0.5).cast("long")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("region_key", F.coalesce(F.col("region_id").cast("string"), F.lit("")))

    every = (
        keyed(lines)
        .join(keyed(spots).withColumnRenamed("region_id", "_spots"), "region_key", "full")
        .join(keyed(parts).withColumnRenamed("region_id", "_parts"), "region_key", "full")
    )
    return (
        every.withColumn("region_id", F.coalesce("region_id", "_spots", "_parts"))
        .withColumn("largest_component_pct", share)
        .drop("region_key", "_spots", "_parts")
    )


def sample_names(segments: DataFrame, count: int = 20) -> DataFrame:
    """The first names per region in alphabetical order."""
    names = segments.filter("length(name) > 0").select("region_id", "name").distinct()
    first = Window.partitionBy("region_id").orderBy("name")
    return (
        names.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= count)
        .groupBy("region_id")
        .agg(F.array_sort(F.collect_list("name")).alias("names"))
    )


def top_components(component_sizes: DataFrame, count: int = 5) -> DataFrame:
    largest = Window.partitionBy("region_id").orderBy(F.desc("size"), F.asc("component"))
    return component_sizes.withColumn("rank", F.row_number().over(largest)).filter(
        F.col("rank") <= count
    )
