"""Distances and path counts between all pairs of nodes, by numpy kernels in tasks over blocks of start nodes.

A graph of at most ``HELD_EDGES`` simple edges goes to every worker as two arrays of neighbours (8 bytes an edge);
a task adds a block of start nodes, whose state is bounded by ``STATE``. Nothing is shuffled but a row a node (and,
for betweenness, a task). Work is quadratic in the nodes, memory isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.staging import staged

HELD_EDGES = 16_000_000
STATE = 1 << 21  # cells of a block: words of 64 start nodes, or (start node, node) pairs
EDGES_AT_ONCE = 1 << 21
Arrays = tuple[np.ndarray, ...]


def held(pairs: DataFrame) -> Arrays | None:
    """(ids, heads' offsets, heads, tails' offsets, tails) of distinct (src, dst), loops left out; None: too large."""
    if dict(pairs.dtypes)["src"] not in ("tinyint", "smallint", "int", "bigint") or pairs.count() > HELD_EDGES:
        return None
    table = pairs.toArrow()
    src, dst = (table[c].to_numpy() for c in ("src", "dst"))
    ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
    src, dst = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst))
    proper = src != dst
    src, dst = src[proper], dst[proper]
    out: list[np.ndarray] = [ids]
    for a, b in ((src, dst), (dst, src)):
        order = np.lexsort((b, a))
        out += [np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(ids)))]).astype(np.int64), b[order]]
    return tuple(out)


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + lengths[i] - 1 of all i, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(first - before, lengths) + np.arange(int(lengths.sum()))


def _slices(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` in all, one element at least."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield slice(at, to)
        at = to


def _ored(front: np.ndarray, ends: np.ndarray, offsets: np.ndarray, others: np.ndarray, new: np.ndarray) -> None:
    """new[v] = the bits of all ``others`` of v, for ``ends`` that have some."""
    degree = offsets[ends + 1] - offsets[ends]
    ends, degree = ends[degree > 0], degree[degree > 0]
    for part in _slices(degree, max(EDGES_AT_ONCE // front.shape[1], 1)):
        n = degree[part]
        new[ends[part]] = np.bitwise_or.reduceat(front[others[_ranges(offsets[ends[part]], n)]], np.cumsum(n) - n, axis=0)


def _column_counts(bits: np.ndarray) -> np.ndarray:
    total = np.zeros(bits.shape[1] * 64, np.int64)
    octets = bits.view(np.uint8)
    for at in range(0, len(octets), 255):
        total += np.add.reduce(np.unpackbits(octets[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def _levels(graph: Arrays, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, number of nodes first reached at that depth by each start), a bit a start and node."""
    ids, out, heads, into, tails = graph
    rows, cols = np.arange(len(starts)) // 64, np.arange(len(starts)) % 64
    seen = np.zeros((len(ids), -(-len(starts) // 64)), np.uint64)
    np.bitwise_or.at(seen, (starts, rows), np.uint64(1) << cols.astype(np.uint64))
    full = np.zeros(seen.shape[1], np.uint64)
    np.bitwise_or.at(full, rows, np.uint64(1) << cols.astype(np.uint64))
    front, active, depth = seen.copy(), np.unique(starts), 0
    while len(active):
        depth += 1
        degree, new = out[active + 1] - out[active], np.zeros_like(seen)
        if int(degree.sum()) * 8 < len(heads):
            to = heads[_ranges(out[active], degree)]
            order = np.argsort(to, kind="stable")
            to, source = to[order], np.repeat(active, degree)[order]
            ends = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            n = np.diff(np.append(ends, len(to)))
            for part in _slices(n, max(EDGES_AT_ONCE // seen.shape[1], 1)):
                first, size = ends[part][0], n[part]
                new[to[ends[part]]] = np.bitwise_or.reduceat(front[source[first : first + int(size.sum())]], np.cumsum(size) - size, axis=0)
        else:
            _ored(front, np.flatnonzero((seen != full).any(axis=1)), into, tails, new)
        new &= ~seen
        seen |= new
        front, active = new, np.flatnonzero(new.any(axis=1))
        if len(active):
            yield depth, _column_counts(new[active])[: len(starts)]


def _distance_sums(graph: Arrays, starts: np.ndarray) -> pa.RecordBatch:
    far, reached, near = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts))
    for depth, n in _levels(graph, starts):
        far += depth * n
        reached += n
        near += n / depth
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (graph[0][starts], far, reached, near)], ["node_id", "far", "reached", "h"])


def _dependencies(graph: Arrays, starts: np.ndarray) -> np.ndarray:
    """Brandes' sums of the start nodes at every node; a cell is a (start, node) pair."""
    ids, out, heads = graph[:3]
    n, cells = len(ids), len(ids) * len(starts)
    depth, sigma, mark = np.full(cells, -1, np.int32), np.zeros(cells), np.empty(cells, np.int32)
    first = np.arange(len(starts)) * n + starts
    depth[first], sigma[first] = 0, 1.0
    levels, left = [first], cells - len(first)

    def arcs(cell: np.ndarray) -> Iterator[Arrays]:
        """(cells, numbers of their arcs, cells the arcs lead to), so many at once."""
        node = cell % n
        degree = out[node + 1] - out[node]
        cell, node, degree = (x[degree > 0] for x in (cell, node, degree))
        for part in _slices(degree, EDGES_AT_ONCE):
            size = degree[part]
            yield cell[part], size, np.repeat(cell[part] - node[part], size) + heads[_ranges(out[node[part]], size)]

    while left and len(levels[-1]):
        d, fresh = len(levels), []
        for cell, size, to in arcs(levels[-1]):
            ahead = (depth[to] < 0) | (depth[to] == d)
            to, carried = to[ahead], np.repeat(sigma[cell], size)[ahead]
            np.add.at(sigma, to, carried)
            new = to[depth[to] < 0]
            mark[new] = np.arange(len(new), dtype=np.int32)
            fresh.append(new[mark[new] == np.arange(len(new), dtype=np.int32)])
            depth[new] = d
        levels.append(np.concatenate(fresh) if fresh else np.zeros(0, np.int64))
        left -= len(levels[-1])
    delta, share = np.zeros(cells), np.zeros(cells)
    for d in range(len(levels) - 1, 0, -1):
        share[levels[d]] = (1 + delta[levels[d]]) / sigma[levels[d]]
        for cell, size, to in arcs(levels[d - 1]):
            delta[cell] = sigma[cell] * np.add.reduceat(share[to], np.cumsum(size) - size)
        share[levels[d]] = 0
    delta[first] = 0
    return delta.reshape(len(starts), n).sum(axis=0)


def _by_blocks(pairs: DataFrame, graph: Arrays, block: int, schema: str, measure: Callable[[Arrays, Iterator[np.ndarray]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The staged rows of ``measure``(graph, blocks of start nodes), in tasks of some blocks each."""
    spark, n = pairs.sparkSession, len(graph[0])
    n_blocks = -(-n // block)
    sent = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (np.arange(k, n, n_blocks) for b in batches for k in b["id"].to_pylist())
        yield from measure(sent.value, blocks)

    out = staged(spark.range(0, n_blocks, 1, min(n_blocks, 8 * spark.sparkContext.defaultParallelism)).mapInArrow(run, schema), "measured")
    sent.unpersist()
    return out


def _block(pairs: DataFrame, n: int, most: int) -> int:
    """Start nodes a block: few enough for every core to have some."""
    return max(min(most, -(-n // (4 * pairs.sparkSession.sparkContext.defaultParallelism))), 1)


def distance_sums(pairs: DataFrame, graph: Arrays) -> DataFrame:
    """(node_id, far, reached, h): the sum, number and sum of inverses of the distances from each node that are above 0."""
    n = len(graph[0])
    block = -(-_block(pairs, n, max(min(1024, STATE * 64 // max(n, 1)), 64)) // 64) * 64

    def measure(g: Arrays, blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for starts in blocks:
            yield _distance_sums(g, starts)

    return _by_blocks(pairs, graph, block, "node_id long, far long, reached long, h double", measure)


def dependencies(pairs: DataFrame, graph: Arrays) -> DataFrame:
    """(node, c): parts of Brandes' sums over all start nodes, a row a node and task."""
    n = len(graph[0])

    def measure(g: Arrays, blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(g[0]))
        for starts in blocks:
            total += _dependencies(g, starts)
        if total.any():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(g[0][some]), pa.array(total[some])], ["node", "c"])

    return _by_blocks(pairs, graph, _block(pairs, n, max(STATE // max(n, 1), 1)), "node long, c double", measure)
