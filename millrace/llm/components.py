"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut


def _checksum(edges: DataFrame) -> tuple:
    # xor is independent of the order of rows and can't overflow
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any orderable type -> (node, component), the smallest node reachable.

    Only nodes with an edge to another node are returned; null ends and loops are dropped, repeated
    edges count once, and an empty table gives an empty one. Every round moves at most two rows per
    edge; the minimum of a node's neighbours is a partial aggregate, computed apart from the join with
    it, which Spark may then broadcast or split, so a node with very many neighbours needn't be
    gathered in a task. Rounds grow with the logarithm of the longest path.
    """
    edges = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _checksum(edges)
    while before[0]:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = broadcast_if_small(cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))))
        large = (
            both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: a node and its smaller neighbours move to the smallest of them
        large = cut(large)
        least = broadcast_if_small(cut(large.groupBy("a").agg(F.min("b").alias("m"))))
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.union(least.toDF("a", "b")).distinct())
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )
