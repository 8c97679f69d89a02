"""Connected components of links by alternating large-star and small-star steps, on DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, kept


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``links`` (a, b).

    Each round hangs a node's larger neighbours (large star), then its smaller
    ones and itself (small star) on its smallest neighbour; it ends when a
    round changes no link. A node with many links is a group of links whose
    minimum is aggregated before the shuffle; the join that follows deals it
    out by the node, which adaptive execution splits where it is skewed.
    """
    edges = kept(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = kept(spark, small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, edges)
        edges = after
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
