"""Shortest paths from many start nodes, in tasks that hold the edges and deal with one start node at a time.

Paths are neither shuffled nor stored. ``HELD_EDGES`` bounds what goes to a worker (20 bytes an edge).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allpairs import Arrays, _ranges, _slices

HELD_EDGES = 8_000_000
AT_ONCE = 1 << 22
BATCH = 1 << 16
Paths = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # node, hops, inner and last nodes, edges, total


def held(step: DataFrame) -> Arrays | None:
    """(ids, offsets, heads, edge ids, weights) of (edge_id, src, dst, w) without loops, by source and edge; None: too large."""
    kinds = dict(step.dtypes)
    if any(kinds[c] not in ("tinyint", "smallint", "int", "bigint") for c in ("edge_id", "src", "dst")) or step.count() > HELD_EDGES:
        return None
    table = step.where("src <> dst").select("edge_id", "src", "dst", "w").toArrow()
    edge, src, dst, w = (table[c].to_numpy() for c in table.column_names)
    del table
    ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)])).astype(np.int64)
    src, dst = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst))
    order = np.lexsort((edge, src))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))]).astype(np.int64)
    return ids, offsets, dst[order], edge[order].astype(np.int64), w[order].astype(np.float64)


def _any(graph: Arrays, start: int, most: int, state: Arrays) -> Paths:
    """The best path to each node by (weight, hops, edges): one relaxation a hop.

    Paths that go on have as many hops as there were rounds; they are taken in the order of their edges, so that of
    equal candidates the first is the least. A way back to a node of the path itself can't be better.
    """
    ids, offsets, heads, edge, w = graph
    total, new, first = state
    total[start] = new[start] = 0.0
    width = min(most, len(ids))
    nodes, edges, hops = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64), np.zeros(len(ids), np.int32)
    front = np.array([start])
    for h in range(width):
        degree = offsets[front + 1] - offsets[front]
        trail = nodes[front], edges[front]
        cost = total[front]
        better, best_row, best_arc = [], [], []
        for part in _slices(degree, AT_ONCE):
            at = _ranges(offsets[front[part]], degree[part])
            row = np.repeat(np.arange(part.start, part.stop), degree[part])
            to, sums = heads[at], np.repeat(cost[part], degree[part]) + w[at]
            less = sums < new[to]
            at, row, to, sums = at[less], row[less], to[less], sums[less]
            np.minimum.at(new, to, sums)
            win = np.flatnonzero(sums == new[to])[::-1]
            first[to[win]] = win
            ends = np.unique(to[win])
            better.append(ends)
            best_row.append(row[first[ends]])
            best_arc.append(at[first[ends]])
        if not better:
            break
        ends, row, arc = np.concatenate(better), np.concatenate(best_row), np.concatenate(best_arc)
        if not len(ends):
            break
        ends, last = np.unique(ends[::-1], return_index=True)  # a later slice was strictly better
        row, arc = row[::-1][last], arc[::-1][last]
        nodes[ends], edges[ends] = trail[0][row], trail[1][row]
        nodes[ends, h], edges[ends, h], hops[ends] = ids[heads[arc]], edge[arc], h + 1
        total[ends] = new[ends]
        front = ends[np.lexsort(edges[ends, : h + 1].T[::-1])]
    reached = np.flatnonzero(hops)
    out = reached, hops[reached], nodes[reached], edges[reached], total[reached].copy()
    total[:] = new[:] = np.inf
    return out


def _few(graph: Arrays, start: int, most: int, keep: int | None) -> Iterator[Paths]:
    """Of all simple paths of one or two hops the ``keep`` best to each node (None: all of the least weight)."""
    ids, offsets, heads, edge, w = graph
    one = np.arange(offsets[start], offsets[start + 1])
    degree = offsets[heads[one] + 1] - offsets[heads[one]] if most > 1 else np.zeros(len(one), np.int64)
    n_parts = -(-(int(degree.sum()) + len(one)) // AT_ONCE)
    for k in range(n_parts):  # by end node, so that a part has all paths of its nodes
        mine = one[heads[one] % n_parts == k]
        before, after = [np.full(len(mine), -1)], [mine]
        for part in _slices(degree, AT_ONCE):
            two, prefix = _ranges(offsets[heads[one[part]]], degree[part]), np.repeat(one[part], degree[part])
            good = (heads[two] != start) & (heads[two] % n_parts == k)
            before.append(prefix[good])
            after.append(two[good])
        a, b = np.concatenate(before), np.concatenate(after)
        direct = a < 0
        total = w[b] + np.where(direct, 0.0, w[a])
        node, e1 = heads[b], np.where(direct, edge[b], edge[a])
        order = np.lexsort((np.where(direct, 0, edge[b]), e1, ~direct, total, node))
        a, b, direct, total, node = (x[order] for x in (a, b, direct, total, node))
        opens = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
        first = np.flatnonzero(opens)
        group = np.cumsum(opens) - 1
        good = total == total[first][group] if keep is None else np.arange(len(node)) - first[group] < keep
        a, b, direct, total, node = (x[good] for x in (a, b, direct, total, node))
        inner = np.where(direct, b, a)
        yield node, 2 - direct.astype(np.int32), np.stack([ids[heads[inner]], ids[node]], axis=1), np.stack([edge[inner], edge[b]], axis=1), total


def _rows(starts: list[int], parts: list[Paths], ids: np.ndarray) -> pa.RecordBatch:
    """Arrow rows of paths; -1 as a node means the start itself."""
    size = [len(p[0]) for p in parts]
    start = np.repeat(np.array(starts, np.int64), size)
    node = np.concatenate([ids[p[0]] if len(p[0]) and p[0][0] >= 0 else np.full(len(p[0]), s) for s, p in zip(starts, parts, strict=True)])
    hops, total = (np.concatenate([p[k] for p in parts]).astype(t) for k, t in ((1, np.int64), (4, np.float64)))
    width = max(p[2].shape[1] for p in parts)
    wide = [np.concatenate([np.pad(p[k], ((0, 0), (0, width - p[k].shape[1]))) for p in parts]) for k in (2, 3)]
    used = np.arange(width) < hops[:, None]
    lists = []
    for values, lead in ((np.concatenate([start[:, None], wide[0]], axis=1)[np.concatenate([np.ones((len(start), 1), bool), used], axis=1)], 1), (wide[1][used], 0)):
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hops + lead)]).astype(np.int32)), pa.array(values)))
    return pa.RecordBatch.from_arrays([pa.array(start), pa.array(node), *lists, pa.array(total)], ["start", "node", "nodes", "edges", "total_weight"])


def shortest(starts: DataFrame, graph: Arrays, selector: str, k: int, least: int, most: int) -> DataFrame:
    """As :func:`match.shortest`, for ANY of any hops, K and ALL of at most two; ``least`` is 0 or 1."""
    spark = starts.sparkSession
    sent, keep = spark.sparkContext.broadcast(graph), {"ANY": 1, "ALL": None, "K": k}[selector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        ids, from_, parts, n = g[0], [], [], 0
        state = np.full(len(ids), np.inf), np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
        none = np.zeros((1, 0), np.int64)
        for batch in batches:
            for s in batch["start"].to_pylist():
                at = int(np.searchsorted(ids, s))
                inside = at < len(ids) and ids[at] == s and most > 0
                found = [(np.array([-1]), np.zeros(1, np.int64), none, none, np.zeros(1))] if least == 0 else []
                found += ([_any(g, at, most, state)] if keep == 1 else list(_few(g, at, most, keep))) if inside else []
                for p in found:
                    for cut in range(0, len(p[0]), BATCH):
                        part = tuple(x[cut : cut + BATCH] for x in p)
                        from_.append(s)
                        parts.append(part)
                        n += len(part[0])
                        if n >= BATCH:
                            yield _rows(from_, parts, ids)
                            from_, parts, n = [], [], 0
        if parts:
            yield _rows(from_, parts, ids)

    few = starts.select(F.col("start").cast("long")).where("start IS NOT NULL").distinct().repartition(8 * spark.sparkContext.defaultParallelism)
    return few.mapInArrow(run, "start long, node long, nodes array<long>, edges array<long>, total_weight double")
