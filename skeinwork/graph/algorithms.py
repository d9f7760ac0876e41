"""Graph algorithms as iterative DataFrame programs over an edge table (edge_id, src, dst).

The node set is the edges' ends; results are keyed by node_id; an empty edge table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import join_hot, scratch, staged, unstage
from . import allpairs
from .edges import nodes, undirected
from .traverse import reach

LOUVAIN_EDGES = 40_000_000
HELD_NODES = 1_000_000  # rows of at most so many nodes are broadcast to the edges
TRIANGLE_EDGES = 8_000_000  # arcs that a task looks for triangles in
LOUVAIN_SLICE = 4_000_000  # edges that the driver receives at once
ORIGINS = 4096  # start nodes whose distances are held at once


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """score after exactly ``iterations`` rounds; parallel edges count, dangling mass is spread evenly."""
    degree = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    n = nodes(edges).count()
    if not n:
        return edges.sparkSession.createDataFrame([], f"node_id {dict(edges.dtypes)['src']}, score double")
    links = staged(edges.groupBy("src", "dst").agg(F.count("*").alias("times")), "links")
    ranks = staged(nodes(edges).join(degree, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(1.0 / n).alias("score")), "ranks")
    for _ in range(iterations):
        loose = ranks.where("degree = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose")).first()["loose"]
        old, sent = ranks, links.join(ranks.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("score") / F.col("degree") * F.col("times")).alias("got"))
        ranks = staged(ranks.join(sent, "node_id", "left").select("node_id", "degree", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("score")), "ranks")
        unstage(old)
    unstage(links)
    return ranks.select("node_id", "score")


def _least_labels(labels: DataFrame, hops: DataFrame) -> DataFrame:
    """(node_id, label) with every label carried along ``hops`` (src to dst) until nothing gets less.

    A label is a node that reaches the one it is given to, so each round also takes the label's own label: rounds
    grow with the logarithm of the longest way. ``labels`` has every node.
    """
    labels = staged(labels, "labels")
    near = F.broadcast if labels.count() <= HELD_NODES else lambda df: df  # the edges stay where they are
    while True:
        got = hops.join(near(labels.withColumnRenamed("node_id", "src")), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("label").alias("got"))
        step = labels.join(got, "node_id", "left").select("node_id", F.col("label").alias("old"), F.least("label", F.coalesce("got", "label")).alias("step"))
        beyond = labels.select(F.col("node_id").alias("step"), F.col("label").alias("jump"))
        new = staged(step.join(beyond, "step", "left").select("node_id", "old", F.least("step", F.coalesce("jump", "step")).alias("label")), "labels")
        settled = new.where("label <> old").isEmpty()
        unstage(labels)
        labels = new.select("node_id", "label")
        if settled:
            return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """component_id: the least node of the weak component."""
    edges = _simple(edges)
    hops = staged(undirected(edges), "hops")
    return _least_labels(nodes(edges).withColumn("label", F.col("node_id")), hops).withColumnRenamed("label", "component_id")


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """component_id (the least node) and component_size; loops don't matter.

    Colouring: least labels run forward; nodes that keep their own are roots; those of a root's colour
    that reach it are its component. Components leave, and the rest is coloured again.
    """
    left, hops, done = staged(nodes(edges), "left"), staged(edges.where("src <> dst").select("src", "dst").distinct(), "hops"), None
    while not left.isEmpty():
        colours = _least_labels(left.withColumn("label", F.col("node_id")), hops)
        inside = hops.join(colours.withColumnsRenamed({"node_id": "src", "label": "a"}), "src").join(colours.withColumnsRenamed({"node_id": "dst", "label": "b"}), "dst").where("a = b")
        back = staged(inside.select(F.monotonically_increasing_id().alias("edge_id"), F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        roots = colours.where("node_id = label").select(F.col("node_id").alias("origin"), F.col("node_id").alias("node"))
        found = staged(reach(back, roots, max_visited=None, max_depth=1 << 30, include_start=True).select(F.col("node").alias("node_id"), F.col("origin").alias("component_id")), "components")
        done = found if done is None else done.union(found)
        left = staged(left.join(found, "node_id", "left_anti"), "left")
        gone = found.select("node_id")
        hops = staged(hops.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti"), "hops")
    if done is None:
        return left.select("node_id", F.col("node_id").alias("component_id"), F.lit(0).cast("long").alias("component_size"))
    return done.join(done.groupBy("component_id").agg(F.count("*").alias("component_size")), "component_id").select("node_id", "component_id", "component_size")


def _batches(edges: DataFrame, measure: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The union of ``measure``(simple edges, starts) over batches of about ``ORIGINS`` start nodes.

    A batch's frontiers are deleted once it is measured, so that no more than one batch's pairs are stored;
    what stays of it should be small.
    """
    with scratch() as keep:
        simple = staged(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id")), "simple")
        everyone = staged(nodes(edges), "nodes")
        n = -(-everyone.count() // ORIGINS)
        for k in range(max(n, 1)):
            starts = everyone.where(F.pmod(F.xxhash64("node_id"), F.lit(max(n, 1))) == k).select(F.col("node_id").alias("origin"), F.col("node_id").alias("node"))
            with scratch() as inner:
                inner.append(staged(measure(simple, starts), "measured"))
            keep += inner
    out = keep[0]
    for part in keep[1:]:
        out = out.union(part)
    return out


def _simple(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst), staged: an edge table may be a query, and each use would run it again."""
    return staged(edges.select("src", "dst").distinct(), "pairs")


def _distances(simple: DataFrame, starts: DataFrame) -> DataFrame:
    """(origin, node, depth > 0) of all pairs with a directed path from a start: one join a level."""
    return reach(simple, starts, max_visited=None, max_depth=1 << 30)


def _distance_sums(pairs: DataFrame) -> DataFrame:
    """(node_id, far, reached, h) of the nodes' distances along out edges; a graph too large to be held takes joins."""
    graph = allpairs.held(pairs)
    if graph is not None:
        return allpairs.distance_sums(pairs, graph)
    numbered = pairs.withColumn("edge_id", F.lit(0).cast("long"))
    return _batches(numbered, lambda e, starts: _distances(e, starts).groupBy(F.col("origin").alias("node_id")).agg(F.sum("depth").alias("far"), F.count("*").alias("reached"), F.sum(1.0 / F.col("depth")).alias("h")))


def closeness(edges: DataFrame, variant: str = "standard") -> DataFrame:
    """closeness, sum_farness, reachable_count (with itself), component_size (weak) and normalized_closeness."""
    if variant not in ("standard", "wasserman_faust"):
        raise ValueError(f"unknown variant {variant!r}")
    edges = _simple(edges)
    far, weak = _distance_sums(edges), connected_components(edges)
    sizes = weak.groupBy("component_id").agg(F.count("*").alias("component_size"))
    out = weak.join(sizes, "component_id").join(far, "node_id", "left").withColumns({"far": F.coalesce("far", F.lit(0)).cast("double"), "reached": F.coalesce("reached", F.lit(0))})
    n = nodes(edges).count()
    standard = F.when(F.col("far") > 0, F.col("reached") / F.col("far")).otherwise(0.0)
    share = F.col("reached") / F.lit(float(max(n - 1, 1)))
    return out.select(
        "node_id", (standard if variant == "standard" else share * standard).alias("closeness"), F.col("far").alias("sum_farness"),
        (F.col("reached") + 1).alias("reachable_count"), "component_size", (share * standard).alias("normalized_closeness"),
    )


def harmonic(edges: DataFrame) -> DataFrame:
    """harmonic (sum of 1 / distance along out edges) and normalized_harmonic."""
    edges = _simple(edges)
    n, near = nodes(edges).count(), _distance_sums(edges)
    value = F.coalesce("h", F.lit(0.0))
    return nodes(edges).join(near, "node_id", "left").select("node_id", value.alias("harmonic"), (value / float(max(n - 1, 1))).alias("normalized_harmonic"))


def _dependencies(simple: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, c): Brandes' sums over the start nodes; path counts forward, dependencies backward, by level."""
    depth = staged(reach(simple, starts, max_visited=None, max_depth=1 << 30, include_start=True).select("origin", "node", "depth"), "depth")
    most = depth.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]
    arcs = simple.join(depth.select("origin", F.col("node").alias("src"), F.col("depth").alias("d")), "src")
    arcs = staged(arcs.join(depth.select("origin", F.col("node").alias("dst"), F.col("depth").alias("e")), ["origin", "dst"]).where("e = d + 1").select("origin", "src", "dst", "e"), "arcs")
    levels = [staged(depth.where("depth = 0").select("origin", "node", F.lit(1.0).alias("sigma")), "sigma")]
    for d in range(1, most + 1):
        step = arcs.where(F.col("e") == d).join(levels[-1].withColumnRenamed("node", "src"), ["origin", "src"])
        levels.append(staged(step.groupBy("origin", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma")), "sigma"))
    delta, total = None, starts.select("node", F.lit(0.0).alias("delta"))
    for d in range(most, 0, -1):
        below = levels[d].select("origin", F.col("node").alias("dst"), F.col("sigma").alias("below"))
        below = below.join(delta.withColumnRenamed("node", "dst"), ["origin", "dst"], "left") if delta is not None else below.withColumn("delta", F.lit(0.0))
        step = arcs.where(F.col("e") == d).join(below, ["origin", "dst"]).join(levels[d - 1].withColumnRenamed("node", "src"), ["origin", "src"])
        delta = staged(step.groupBy("origin", F.col("src").alias("node")).agg(F.sum(F.col("sigma") / F.col("below") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("delta")), "delta")
        total = total.union(delta.where("origin <> node").select("node", "delta"))
    return total.groupBy("node").agg(F.sum("delta").alias("c"))


def betweenness(edges: DataFrame, normalized: bool = True) -> DataFrame:
    """centrality by Brandes' sums over all sources, a block of sources at a time; a graph too large to be held takes joins."""
    pairs = _simple(edges)
    everyone, graph = nodes(pairs), allpairs.held(pairs)
    n = everyone.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    parts = _batches(pairs.withColumn("edge_id", F.lit(0).cast("long")), _dependencies) if graph is None else allpairs.dependencies(pairs, graph)
    got = parts.groupBy(F.col("node").alias("node_id")).agg(F.sum("c").alias("c"))
    return everyone.join(got, "node_id", "left").select("node_id", (F.coalesce("c", F.lit(0.0)) * scale).alias("centrality"))


def degree_centrality(edges: DataFrame, direction: str = "all") -> DataFrame:
    """in_degree, out_degree, degree and normalized_degree; parallel edges count."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    both = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    degree = {"all": F.col("in_degree") + F.col("out_degree"), "in": F.col("in_degree"), "out": F.col("out_degree")}
    if direction not in degree:
        raise ValueError(f"unknown direction {direction!r}")
    n = nodes(edges).count()
    return both.select("node_id", "in_degree", "out_degree", degree[direction].alias("degree"), (degree[direction] / float(max(n - 1, 1))).alias("normalized_degree"))


def eigenvector(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """score and iterations_used: power iteration on A + I in each weak component, all components at once."""
    edges = _simple(edges)
    hops = staged(undirected(edges), "hops")
    weak = staged(_least_labels(nodes(edges).withColumn("label", F.col("node_id")), hops).withColumnRenamed("label", "component_id"), "weak")
    n = weak.count()
    near = F.broadcast if n <= HELD_NODES else lambda df: df
    size = staged(weak.groupBy("component_id").agg(F.count("*").alias("size")), "size")
    now = staged(join_hot(weak, size, "component_id", "size", n).select("node_id", "component_id", "size", (1 / F.sqrt(F.col("size").cast("double"))).alias("score"), F.lit(0).alias("used"), (F.col("size") == 1).alias("settled")), "eigen")
    for _ in range(iterations):
        open_rows = now.where("not settled")
        got = hops.join(near(open_rows.select(F.col("node_id").alias("src"), "score")), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("score").alias("got"))
        raw = staged(open_rows.join(got, "node_id", "left").withColumn("raw", F.col("score") + F.coalesce("got", F.lit(0.0))), "raw")
        norms = raw.groupBy("component_id", "size").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        new = staged(join_hot(raw, norms.withColumnRenamed("size", "times"), "component_id", "times", n).drop("times").withColumn("new", F.col("raw") / F.col("norm")), "new")
        moved = new.groupBy("component_id", F.col("size").alias("times")).agg((F.sqrt(F.sum((F.col("new") - F.col("score")) ** 2)) < tolerance).alias("near"))
        ready = join_hot(new, moved, "component_id", "times", n).select("node_id", "component_id", "size", F.col("new").alias("score"), (F.col("used") + 1).alias("used"), F.col("near").alias("settled"))
        old, now = now, staged(ready.union(now.where("settled")), "eigen")
        unstage(old, raw, new)
        if now.where("not settled").isEmpty():
            break
    score = F.when(F.col("size") == 1, 0.0).otherwise(F.col("score"))
    top = now.agg(F.max(score).alias("top")).first()["top"]
    return now.select("node_id", (score / (top if top else 1.0)).alias("score"), F.col("used").alias("iterations_used"))


def _closed(task: pa.Table) -> pa.Table:
    """(node_id, n) of one task's triangles a < b < c: arcs of part 0 are ab, of part 1 ac, of part 2 bc."""
    part, src, dst = (task[c].to_numpy() for c in ("part", "src", "dst"))
    ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
    src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    (a, b), (a2, c2), (b3, c3) = ((src[part == k], dst[part == k]) for k in range(3))
    n, total = np.int64(len(ids)), np.zeros(len(ids), np.int64)
    third = np.sort(a2 * n + c2)
    c3 = c3[np.argsort(b3, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(b3, minlength=len(ids)))])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    degree = offsets[b + 1] - offsets[b]
    for at in allpairs._slices(degree, allpairs.EDGES_AT_ONCE) if len(third) else ():
        c = c3[allpairs._ranges(offsets[b[at]], degree[at])]
        x, y = np.repeat(a[at], degree[at]), np.repeat(b[at], degree[at])
        key = x * n + c
        hit = third[np.minimum(np.searchsorted(third, key), len(third) - 1)] == key
        for v in (x, y, c):
            total += np.bincount(v[hit], minlength=len(ids))
    some = np.flatnonzero(total)
    return pa.table({"node_id": pa.array(ids[some].astype(np.int64)), "n": pa.array(total[some])})


def _triangles(hops: DataFrame) -> DataFrame:
    """(node_id, n): triangles at each node of staged undirected edges, each found once by its ends in order of degree.

    Nodes have one of p colours; a task has the arcs between three colours, about ``TRIANGLE_EDGES`` of them, and
    wedges never leave it. An arc goes to 3 p tasks, p growing with the root of the edges.
    """
    degree = hops.groupBy("src").agg(F.count("*").alias("k"))
    arcs = hops.join(degree, "src").join(degree.withColumnsRenamed({"src": "dst", "k": "m"}), "dst").where("m > k or m = k and dst > src").select("src", "dst")
    p = max(2, int(np.ceil((1.5 * hops.count() / TRIANGLE_EDGES) ** 0.5)))
    x, y = (F.pmod(F.xxhash64(c), F.lit(p)).cast("int") for c in ("src", "dst"))
    places = lambda k: F.array(*[F.struct(F.lit(i).alias("part"), ((u * p + v) * p + w).cast("int").alias("task")) for i, (u, v, w) in enumerate(((x, y, k), (x, k, y), (k, x, y)))])
    dealt = arcs.select("src", "dst", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), places))).alias("to")).select("src", "dst", "to.part", "to.task")
    return dealt.groupBy("task").applyInArrow(_closed, "node_id long, n long").groupBy("node_id").agg(F.sum("n").alias("n"))


def triangle_count(edges: DataFrame) -> DataFrame:
    edges = _simple(edges)
    hops = staged(undirected(edges), "hops")
    return nodes(edges).join(_triangles(hops), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("triangle_count"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """local_coefficient 2T / (k (k - 1)), 0 below two neighbours; triangles and degree."""
    edges = _simple(edges)
    hops = staged(undirected(edges), "hops")
    degree = hops.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("k"))
    out = nodes(edges).join(degree, "node_id", "left").join(_triangles(hops), "node_id", "left").withColumns({"k": F.coalesce("k", F.lit(0)).cast("long"), "n": F.coalesce("n", F.lit(0)).cast("long")})
    return out.select("node_id", F.when(F.col("k") > 1, 2.0 * F.col("n") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("local_coefficient"), F.col("n").alias("triangles"), F.col("k").alias("degree"))


def _neighbours(pairs: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and neighbours' places in ``ids`` of undirected (src, dst); the driver gets a slice at a time."""
    n_slices = -(-pairs.count() // LOUVAIN_SLICE)
    heads, tails = [], []
    for k in range(n_slices):
        got = pairs.where(F.pmod(F.xxhash64("src"), F.lit(n_slices)) == k).toArrow()
        src, dst = (np.searchsorted(ids, got[c].to_numpy()).astype(np.int32) for c in ("src", "dst"))
        heads += [src, dst]
        tails += [dst, src]
    src, dst = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (heads, tails))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
    return offsets, dst[np.argsort(src, kind="stable")]


def _moves(offsets: np.ndarray, to: np.ndarray, weight: np.ndarray, resolution: float, total: float, max_iterations: int) -> np.ndarray:
    """Each node's community (a node of it) after Louvain's moves of one level, nodes in ascending order."""
    n = len(offsets) - 1
    strength = np.bincount(np.repeat(np.arange(n), np.diff(offsets)), weights=weight, minlength=n)
    home, inside = np.arange(n), strength.copy()
    for _ in range(max_iterations):
        moved = False
        for v in range(n):
            others, w = to[offsets[v] : offsets[v + 1]], weight[offsets[v] : offsets[v + 1]]
            own = others == v
            if own.any():
                others, w = others[~own], w[~own]
            near, place = np.unique(home[others], return_inverse=True)
            sums = np.bincount(place, weights=w, minlength=len(near))
            old, k = home[v], strength[v]
            inside[old] -= k
            at = np.searchsorted(near, old)
            best, gain = old, (sums[at] if at < len(near) and near[at] == old else 0.0) - resolution * k * inside[old] / total
            gains = sums - resolution * k * inside[near] / total
            while True:  # the next one that is better by more than rounding, in ascending order
                better = np.flatnonzero(gains > gain + 1e-12)
                if not len(better):
                    break
                best, gain = near[better[0]], gains[better[0]]
                gains[: better[0] + 1] = -np.inf
            inside[best] += k
            home[v] = best
            moved |= bool(best != old)
        if not moved:
            break
    return home


def community_detect(edges: DataFrame, resolution: float = 1.0, max_iterations: int = 10) -> DataFrame:
    """community_id by multi-level Louvain: nodes in ascending order, ids renumbered by least node.

    The moves are sequential by definition: the simple graph comes to the driver as arrays (about 30 bytes an
    edge), if it has at most ``LOUVAIN_EDGES`` edges; a larger one is refused.
    """
    key = dict(edges.dtypes)["src"]
    edges = _simple(edges)
    pairs = staged(undirected(edges).where("src < dst"), "undirected")
    n_pairs = pairs.count()
    if n_pairs > LOUVAIN_EDGES:
        raise ValueError(f"{n_pairs} edges: Louvain is limited to {LOUVAIN_EDGES}")
    ids = np.sort(nodes(edges).toArrow()["node_id"].to_numpy())
    offsets, to = _neighbours(pairs, ids)
    weight, member = np.ones(len(to)), np.arange(len(ids))
    total = float(len(to))
    while total:
        home = _moves(offsets, to, weight, resolution, total, max_iterations)
        if (home == np.arange(len(home))).all():
            break
        kept, place = np.unique(home, return_inverse=True)
        member, n = place[member], len(kept)
        both, back = np.unique(np.repeat(place, np.diff(offsets)) * np.int64(n) + place[to], return_inverse=True)
        weight, to = np.bincount(back, weights=weight), both % n
        offsets = np.concatenate([[0], np.cumsum(np.bincount(both // n, minlength=n))])
    _, first, place = np.unique(member, return_index=True, return_inverse=True)
    number = np.argsort(np.argsort(first))[place]
    return edges.sparkSession.createDataFrame(pa.table({"node_id": ids, "community_id": number.astype(np.int64)}).cast(pa.schema([("node_id", pa.int64()), ("community_id", pa.int64())]))).select(F.col("node_id").cast(key), "community_id")
