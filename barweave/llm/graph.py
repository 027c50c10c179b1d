"""Connected components as alternating stars: no node's neighbours are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link greater neighbours to the least one. Small star: link lesser neighbours, and the node, to it."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the component's least node."""
    edges = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while not _stars(edges):
        large = scratch.save(_step(edges, True), "large")
        new = scratch.save(_step(large, False), "small")
        scratch.drop(edges, large)
        edges = new
    least = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return least.union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either the least of its neighbours or has one neighbour, which is: then labels are final."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("a", F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)")
    return bad.limit(1).count() == 0
