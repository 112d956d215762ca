"""Connected components by alternating large-star and small-star steps, in joins and aggregates.

Each step gives every node one minimum (pre-aggregated before its shuffle) and moves edges to it, so no
task holds the neighbours of a node. Steps are stored in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b), with every larger (smaller) neighbour of a node tied to the node's least neighbour.

    Large star: both directions of an edge are looked at from ``a``; the larger end goes to the minimum.
    Small star: only the smaller neighbours of ``a``, and ``a`` itself.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    met = both.join(least, "a")
    if large:
        moved = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, ``component`` the least node it can reach.

    Edges have no direction; loops, repeated edges and edges with a NULL end add nothing, and a node that
    has only loops is not put out. No edges give no rows. Any type with an order will do.
    """
    edge = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    now = stored(edge.filter("x is not null and y is not null and a > b").select("a", "b").distinct())
    size = _state(now)
    while True:
        now = stored(_star(_star(now, True), False))
        before, size = size, _state(now)
        if size == before:
            break
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal before and after a step only when nothing moved."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())
