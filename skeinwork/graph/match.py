"""Pattern matching: fixed chains, variable lengths, and shortest-path selectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import held_paths
from .edges import oriented

UNBOUNDED_HOPS = 20
SELECTOR_HOPS = 100
MAX_PATHS = 100_000
HELD_HOPS = 8  # longest paths that are kept as one row of arrays a node while they are sought
HELD_NODES = 1_000_000


def beside(nodes: DataFrame) -> DataFrame:
    """``nodes`` to be joined with paths: broadcast if they are few, so that the paths stay where they are."""
    return F.broadcast(nodes) if nodes.count() <= HELD_NODES else nodes


@dataclass
class Node:
    """A pattern's node: a variable over a table with its key, and a predicate on its columns."""

    name: str
    table: DataFrame
    pk: str
    where: str | None = None

    def rows(self) -> DataFrame:
        table = self.table.where(self.where) if self.where else self.table
        return table.select(*[F.col(c).alias(f"{self.name}.{c}") for c in table.columns])

    @property
    def key(self) -> Column:
        return F.col(f"`{self.name}.{self.pk}`")


@dataclass
class Edge:
    """A pattern's edge: direction, hops (least, most; None: unbounded) and a predicate on its properties."""

    name: str
    edges: DataFrame
    direction: str = "OUT"
    hops: tuple[int, int | None] | None = None
    where: str | None = None

    def rows(self) -> DataFrame:
        table = self.edges.where(self.where) if self.where else self.edges
        return oriented(table, self.direction)


def match(nodes: Sequence[Node], edges: Sequence[Edge], where: str | None = None, max_paths: int = MAX_PATHS) -> DataFrame:
    """Bindings of a chain of nodes and edges, columns ``variable.column``: homomorphisms, as a bag.

    A repeated variable must bind the same row. Fixed hops are joins node - edge - node; variable ones
    give one row a node-simple path. ``where`` sees all variables (write `a.x` in backticks). Edge
    properties are ``r.property``; a variable-length edge gives ``r.path``.
    """
    out = nodes[0].rows()
    seen = {nodes[0].name}
    before = nodes[0]
    for hop, node in zip(edges, nodes[1:], strict=True):
        if hop.hops is None:
            step = hop.rows().select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), *[F.col(c).alias(f"{hop.name}.{c}") for c in hop.edges.columns])
        else:
            step = paths(hop, node, out.select(before.key.alias("start")).distinct(), max_paths).select(F.col("start").alias("__src"), F.col("node").alias("__dst"), F.struct("nodes", "edges").alias(f"{hop.name}.path"))
        out = out.join(step, before.key == F.col("__src"))
        if node.name in seen:
            out = out.where(node.key == F.col("__dst")).drop("__src", "__dst")
        else:
            out = out.join(node.rows(), F.col("__dst") == node.key, "inner" if node.where else "left").drop("__src", "__dst")
        seen.add(node.name)
        before = node
    return out.where(where) if where else out


def paths(hop: Edge, target: Node | None, starts: DataFrame, max_paths: int = MAX_PATHS) -> DataFrame:
    """(start, node, nodes, edges): node-simple paths of least..most hops; one join a hop.

    The target's predicate also prunes inner nodes; a 0-hop path is the start itself, unfiltered.
    """
    least, most = hop.hops
    most = UNBOUNDED_HOPS if most is None else most
    step = hop.rows().select("edge_id", "src", "dst")
    if target is not None and target.where:
        step = step.join(target.table.where(target.where).select(F.col(target.pk).alias("dst")), "dst", "left_semi")
    frontier = starts.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<bigint>").alias("edges"))
    found = frontier if least == 0 else None
    for n in range(1, most + 1):
        longer = frontier.join(step, frontier["node"] == step["src"]).where(~F.array_contains("nodes", F.col("dst")))
        frontier = staged(longer.select("start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges")), "paths")
        count = frontier.count()
        if not count:
            break
        if count > max_paths:
            raise ValueError(f"more than {max_paths} paths of {n} hops")
        if n >= least:
            found = frontier if found is None else found.union(frontier)
    return found if found is not None else frontier.where("false")


def _undominated(pool: DataFrame, keep: int | None, least: int) -> DataFrame:
    """``pool`` without paths that no result can need, however it goes on.

    A path is needless if ``keep`` better ones (None: a strictly shorter one) with the same ends hold no node that
    it lacks: each may go on wherever it may. Below the ``least`` hops only paths of as many hops compare.
    """
    pool = pool.distinct().withColumn("hops", F.least(F.size("edges"), F.lit(least)))
    order = lambda x: F.struct(F.col(f"{x}.total_weight"), F.size(f"{x}.edges"), F.col(f"{x}.edges"))
    shorter = F.col("q.total_weight") < F.col("p.total_weight") if keep is None else order("q") < order("p")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("start", "node", "hops")]
    within = F.size(F.array_except("q.nodes", "p.nodes")) == 0
    pairs = pool.alias("p").join(pool.alias("q"), [*same, shorter, within])
    needless = pairs.groupBy("p.start", "p.node", "p.edges").agg(F.count("*").alias("n")).where(F.col("n") >= (keep or 1))
    return pool.join(needless, ["start", "node", "edges"], "left_anti").select("start", "node", "nodes", "edges", "total_weight")


def shortest(edges: Edge, starts: DataFrame, selector: str = "ANY", k: int = 1, weight: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(start, node, nodes, edges, total_weight): shortest paths from each start to every node.

    ``selector``: ANY (one), ALL (every one of least length) or K (the ``k`` shortest simple paths). With
    ``weight``, a non-negative numeric edge property, length is its sum, else the number of hops. Hop
    bounds hold; the 0-hop path counts only if least is 0. Ties go to the least (edges) list.
    """
    least, most = edges.hops or (1, None)
    most = SELECTOR_HOPS if most is None else most
    rows = edges.rows()
    if weight is None:
        step = rows.select("edge_id", "src", "dst", F.lit(1.0).alias("w"))
    else:
        kind = dict(edges.edges.dtypes).get(weight)
        if kind is None or kind.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            raise ValueError(f"weight {weight!r} is not a numeric edge property")
        if not edges.edges.where(F.col(weight).isNull() | (F.col(weight) < 0)).isEmpty():
            raise ValueError("weights must not be negative or NULL")
        step = rows.select("edge_id", "src", "dst", F.col(weight).cast("double").alias("w"))
    if selector != "ALL":  # of parallel edges, paths take the best ones
        ranked = Window.partitionBy("src", "dst").orderBy("w", "edge_id")
        step = step.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= (k if selector == "K" else 1)).drop("__rank")
    if least <= 1 and (selector == "ANY" and most <= HELD_HOPS or most <= 2) and k > 0:
        step = staged(step, "step")
        graph = held_paths.held(step)
        if graph is not None:
            found = held_paths.shortest(starts, graph, selector, k, least, most)
            return found.join(targets.select(F.col(targets.columns[0]).alias("node")), "node", "left_semi").select(*found.columns) if targets is not None else found
    frontier = starts.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<bigint>").alias("edges"), F.lit(0.0).alias("total_weight"))
    frontier = found = staged(frontier, "shortest")
    keep = {"ANY": 1, "ALL": None, "K": k}[selector]
    for _ in range(most):
        longer = frontier.join(step, frontier["node"] == step["src"]).where(~F.array_contains("nodes", F.col("dst")))
        longer = longer.select("start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"), (F.col("total_weight") + F.col("w")).alias("total_weight"))
        groups = ["start", "node"]
        pool = found.unionByName(longer)
        ordered = Window.partitionBy(*groups).orderBy("total_weight", F.size("edges"), "edges")
        if least > 1 or (selector == "K" and k > 1):
            best = _undominated(pool, keep, least)
        elif selector == "ALL":
            best = pool.withColumn("__best", F.min("total_weight").over(Window.partitionBy(*groups))).where("total_weight = __best").drop("__best")
        else:
            best = pool.withColumn("__rank", F.row_number().over(ordered)).where(F.col("__rank") <= keep).drop("__rank")
        best = staged(best.distinct(), "shortest")
        frontier = best.join(found.select("start", "node", "edges"), ["start", "node", "edges"], "left_anti").select(*found.columns)
        frontier = staged(frontier, "shortest")
        found = best
        if frontier.isEmpty():
            break
    found = found.where(F.size("edges") >= least)
    if least > 1 or (selector == "K" and k > 1):
        ordered = Window.partitionBy("start", "node").orderBy("total_weight", F.size("edges"), "edges")
        rank = F.rank().over(Window.partitionBy("start", "node").orderBy("total_weight")) if selector == "ALL" else F.row_number().over(ordered)
        found = found.withColumn("__rank", rank).where(F.col("__rank") <= (keep or 1)).drop("__rank")
    return found.join(targets.select(F.col(targets.columns[0]).alias("node")), "node", "left_semi").select(*frontier.columns) if targets is not None else found


def path_length(path: Column) -> Column:
    return (F.size(path["nodes"]) - 1).cast("long")


def path_cost(path: Column) -> Column:
    return path["total_weight"]


def path_nodes(path: Column) -> Column:
    return F.to_json(path["nodes"])


def path_edges(path: Column) -> Column:
    return F.to_json(path["edges"])
