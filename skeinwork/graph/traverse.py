"""Breadth-first traversal of one or many start nodes, and unweighted shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import scratch, staged
from .edges import oriented

MAX_DEPTH = 100
MAX_VISITED = 100_000


def reach(edges: DataFrame, starts: DataFrame, direction: str = "OUT", max_depth: int = MAX_DEPTH, trace: bool = False, max_visited: int | None = MAX_VISITED, include_start: bool = False) -> DataFrame:
    """(origin, node, depth, source, edge_id[, path_nodes, path_edges]): nodes reached from each origin.

    ``starts`` has origin and node. The start node itself is not returned (unless ``include_start``), every
    other one once, at its least depth; of several parents the least (source, edge_id) counts. One job
    a level: the frontier meets the edges in a join, is reduced by a minimum, and loses what was visited.
    ``max_visited`` bounds the nodes of one origin; None lifts the bound.
    """
    hops = oriented(edges.select("edge_id", "src", "dst"), direction)
    key = dict(edges.dtypes)["src"]
    frontier = starts.select("origin", F.col("node").cast(key).alias("node")).distinct().select(
        "origin", "node", F.lit(0).alias("depth"), F.lit(None).cast(key).alias("source"), F.lit(None).cast("long").alias("edge_id"),
        *([F.array("node").alias("path_nodes"), F.array().cast("array<bigint>").alias("path_edges")] if trace else []),
    )
    visited = levels = frontier = staged(frontier, "frontier")
    for depth in range(1, max_depth + 1):
        step = frontier.select("origin", F.col("node").alias("src"), *(["path_nodes", "path_edges"] if trace else [])).join(hops, "src")
        first = F.min(F.struct("src", "edge_id", *(["path_nodes", "path_edges"] if trace else []))).alias("first")
        found = step.groupBy("origin", F.col("dst").alias("node")).agg(first).join(visited.select("origin", "node"), ["origin", "node"], "left_anti")
        frontier = found.select(
            "origin", "node", F.lit(depth).alias("depth"), F.col("first.src").alias("source"), F.col("first.edge_id").alias("edge_id"),
            *([F.concat("first.path_nodes", F.array("node")).alias("path_nodes"), F.concat("first.path_edges", F.array("first.edge_id")).alias("path_edges")] if trace else []),
        )
        frontier = staged(frontier, "frontier")
        if frontier.isEmpty():
            break
        levels = visited = levels.unionByName(frontier)
        if max_visited is not None and not visited.groupBy("origin").count().where(F.col("count") > max_visited).isEmpty():
            raise ValueError(f"traversal visited more than {max_visited} nodes")
    return levels if include_start else levels.where("depth > 0")


def traverse(edges: DataFrame, start: object, direction: str = "OUT", max_depth: int = MAX_DEPTH, trace: bool = False, heterogeneous: bool = False, max_visited: int | None = MAX_VISITED) -> DataFrame:
    """(node, depth, source, edge_id[, path]) from one start node; over two node tables one hop at most."""
    spark, key = edges.sparkSession, dict(edges.dtypes)["src"]
    if heterogeneous:
        if direction.upper() == "BOTH":
            raise ValueError("BOTH needs an edge type within one table")
        hop = oriented(edges.select("edge_id", "src", "dst"), direction).where(F.col("src") == F.lit(start).cast(key))
        found = hop.groupBy(F.col("dst").alias("node")).agg(F.min("edge_id").alias("edge_id")).limit(2**31 - 1 if max_depth else 0)
        out = found.select("node", F.lit(1).alias("depth"), F.lit(start).cast(key).alias("source"), "edge_id")
        return out.withColumn("path_nodes", F.array("node")).withColumn("path_edges", F.array("edge_id")) if trace else out
    starts = spark.range(1).select(F.lit(0).alias("origin"), F.lit(start).cast(key).alias("node"))
    return reach(edges, starts, direction, max_depth, trace, max_visited).drop("origin")


def traverse_rows(edges: DataFrame, start: object, table: DataFrame, pk: str, **options) -> DataFrame:
    """Reached nodes with their rows and the properties of the edge taken; a missing row gives NULLs."""
    reached = traverse(edges, start, **options)
    out = reached.join(table, reached["node"] == table[pk], "left")
    props = [c for c in edges.columns if c not in ("edge_id", "src", "dst")]
    if props:
        out = out.join(edges.select("edge_id", *props), "edge_id", "left")
    names = {"node": "__node", "depth": "__depth", "source": "__source"}
    path = [F.struct(F.col("path_nodes").alias("nodes"), F.col("path_edges").alias("edges")).alias("__path")] if "path_nodes" in reached.columns else []
    return out.select(*[table[c] for c in table.columns], *[F.col(a).alias(b) for a, b in names.items()], *path, *props)


def traverse_edges(edges: DataFrame, start: object, direction: str = "OUT", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every edge whose ends were both discovered, as stored: __from, __to, __depth and properties."""
    key = dict(edges.dtypes)["src"]
    starts = edges.sparkSession.range(1).select(F.lit(0).alias("origin"), F.lit(start).cast(key).alias("node"))
    depth = staged(reach(edges, starts, direction, max_depth, include_start=True).select("node", "depth"), "depths")
    out = edges.join(depth.select(F.col("node").alias("src"), F.col("depth").alias("d1")), "src").join(depth.select(F.col("node").alias("dst"), F.col("depth").alias("d2")), "dst")
    props = [c for c in edges.columns if c not in ("edge_id", "src", "dst")]
    return out.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), F.greatest("d1", "d2").alias("__depth"), "edge_id", *props)


def shortest_path(edges: DataFrame, source: object, target: object, direction: str = "OUT", max_depth: int = MAX_DEPTH, max_visited: int | None = MAX_VISITED) -> DataFrame:
    """(node, hop) of one shortest path in order, both ends included; equal ends: hop 0; none: no rows.

    Frontiers grow from both ends, the smaller one first, and the search stops at the level where they meet. Of
    several paths the one through the least meeting node counts, and on both sides of it the least neighbours.
    The path itself is read off the levels, one row each.
    """
    spark, key = edges.sparkSession, dict(edges.dtypes)["src"]
    if source == target:
        return spark.range(1).select(F.lit(source).cast(key).alias("node"), F.lit(0).alias("hop"))
    ahead = oriented(edges.select("edge_id", "src", "dst"), direction).select("src", "dst")
    hops = [ahead, ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"))]
    with scratch():
        levels = [[staged(spark.range(1).select(F.lit(end).cast(key).alias("node"), F.lit(None).cast(key).alias("before")), "end")] for end in (source, target)]
        visited, sizes, seen = [x[0].select("node") for x in levels], [1, 1], [1, 1]
        for _ in range(max_depth):
            side = 0 if sizes[0] <= sizes[1] else 1
            step = levels[side][-1].select(F.col("node").alias("src")).join(hops[side], "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("before"))
            fresh = staged(step.join(visited[side], "node", "left_anti"), "frontier")
            levels[side].append(fresh)
            sizes[side] = fresh.count()
            seen[side] += sizes[side]
            if not sizes[side]:
                break
            met = fresh.join(visited[1 - side], "node", "left_semi").agg(F.min("node").alias("node")).first()["node"]
            if met is not None:
                path = [met]
                for end in (0, 1):
                    deep = next(d for d in range(len(levels[end]) - 1, -1, -1) if not levels[end][d].where(F.col("node") == F.lit(met)).isEmpty())
                    at = met
                    for d in range(deep, 0, -1):
                        at = levels[end][d].where(F.col("node") == F.lit(at)).first()["before"]
                        path = [at, *path] if end == 0 else [*path, at]
                return spark.createDataFrame(list(enumerate(path)), f"hop int, node {key}").select("node", "hop")
            visited[side] = visited[side].union(fresh.select("node"))
            if max_visited is not None and sum(seen) > max_visited:
                raise ValueError(f"the search visited more than {max_visited} nodes")
    return spark.createDataFrame([], f"node {key}, hop int")
