"""Least reachable ids over a table of links, as rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.session import Stages


def least_reachable(links: DataFrame, stages: Stages) -> DataFrame:
    """``node, least`` for every node of the links ``a, b`` that reaches a smaller one.

    Each round points every larger neighbour of a node to the least id around
    it, then every smaller one likewise, until nothing changes. Links shrink to
    stars; a hub is met by a join with one row, which can be split.
    """
    links = stages.cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    while True:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = stages.cut(both.filter("m > n").join(low, "n").select(F.col("m").alias("v"), F.col("low").alias("u")).filter("u <> v").distinct())
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("low").alias("u")), F.struct(F.col("u").alias("v"), F.col("low").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .filter("u <> v")
            .distinct()
        )
        after = stages.cut(small)
        if not after.exceptAll(links).limit(1).count() and not links.exceptAll(after).limit(1).count():
            return after.select(F.col("v").alias("node"), F.col("u").alias("least"))
        links = after
