"""Connected components by alternating large and small stars, each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the smallest neighbour of u (or to u)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("m").alias("a"), F.col("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u, move to the smallest of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the smallest node
    reachable. Nodes that are their own root are left out. Each round is
    written to the shared folder; only a count and a checksum reach the driver.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state = None
    while True:
        now = stored(_small_star(_large_star(now)), "components")
        if (new := _state(now)) == state or not new[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = new
