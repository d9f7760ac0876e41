"""Edge tables: edge_id, src, dst and properties; directions are unions of orientations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("OUT", "IN", "BOTH")


def oriented(edges: DataFrame, direction: str = "OUT") -> DataFrame:
    """``edges`` seen along ``direction``: IN swaps the ends, BOTH holds every edge both ways (loops once)."""
    direction = direction.upper()
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    other = {"src": "dst", "dst": "src"}
    swapped = edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])
    if direction == "OUT":
        return edges
    return swapped if direction == "IN" else edges.unionByName(swapped.where("src <> dst"))


def nodes(edges: DataFrame) -> DataFrame:
    """All ends of edges, each once."""
    return edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways, without loops or parallel edges."""
    one = edges.where("src <> dst").select("src", "dst")
    return one.union(one.select(F.col("dst"), F.col("src"))).distinct()
