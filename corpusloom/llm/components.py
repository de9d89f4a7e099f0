"""Connected components by alternating large-star and small-star steps, each a join and a map-side combined minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every (larger or smaller) neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.join(least, "a")
    out = moved.where("b > a").select("b", "m") if large else moved.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return out.where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node reachable. edges: a, b of one type.

    Steps go on until none changes an edge, about log(nodes) squared of them at most. Null ends take no part.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen, state = None, (-1, None)
    while state != seen and state[0]:
        seen = state
        edges = written(_star(written(_star(edges, True), "large-star"), False), "small-star")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")))
    return ends.groupBy("node").agg(F.min("component").alias("component"))
