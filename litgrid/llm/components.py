"""Connected components of a large graph by alternating large-star and small-star steps.

Every step keeps the components and replaces edges by ones nearer to the smallest node; it ends when each component is a
star around that node. Nothing is collected; the edges of each round are cut from their lineage by checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.session import ready_checkpoints, release_shuffles


def _state(edges: DataFrame) -> tuple[int, int]:
    n, s = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, s or 0


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long; null edges are left out). Returns node, component for each node that has an edge to another; component: the smallest node reachable."""
    ready_checkpoints(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = _state(edges)
    while before[0]:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its neighbours below it go to the smallest of those
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = below.unionAll(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        after = _state(edges)
        release_shuffles(edges.sparkSession)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
