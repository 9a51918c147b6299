"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, drop


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (u, v) are stars: each u has one v, and no v is a u."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("u")
    between = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return several.union(between).isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes that have an edge, from edges (a, b); component is the smallest node.

    Edges with a null node do not count, nor does an edge of a node to itself; repeated edges count once; an empty table gives no rows.

    Each round hooks every node's larger, then its smaller neighbours to its least neighbour; the rounds grow as the logarithm of the longest path.
    A node with very many neighbours is met only by aggregates that combine on the map side and by joins right behind their exchanges, which can be split.
    Each round is written to the shared folder.
    """
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "edges")
        drop(now, least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small, "edges")
        drop(large, least)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    parts = cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "parts")
    drop(now)
    return parts
