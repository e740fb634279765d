"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def least(edges: DataFrame) -> DataFrame:
    """(u, m): each node's smallest neighbour, found by partial aggregates, so that a hub's edges needn't meet in one task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), a null-free pair of longs; the root is its component's smallest node.

    Each turn halves the depth at least, so a component of n nodes takes O(log n)
    turns at most; stars, which duplicates mostly form, take two. What a turn
    gives is written to the shared folder, so lineage doesn't grow.
    """
    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        lowest = least(large)
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        stars = cut(small)
        # the same when no edge changed
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
