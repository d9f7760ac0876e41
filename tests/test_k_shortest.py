"""Shortest-path selectors against all simple paths, on multigraphs with detours."""

import random

import pytest

from skeinwork.graph import match

DETOUR = [(1, 2, 1.0), (2, 3, 1.0), (2, 3, 1.0), (1, 4, 1.0), (4, 3, 1.0), (3, 2, 1.0)]


def multigraph(seed):
    draw = random.Random(seed)
    return [(draw.randrange(6), draw.randrange(6), float(draw.randint(1, 3))) for _ in range(16)]


def simple_paths(pairs, start, most):
    out, stack = [], [([start], [], 0.0)]
    while stack:
        nodes, edges, total = stack.pop()
        out.append((nodes, edges, total))
        if len(edges) < most:
            stack.extend(([*nodes, b], [*edges, i], total + w) for i, (a, b, w) in enumerate(pairs) if a == nodes[-1] and b not in nodes)
    return out


def expected(pairs, start, least, most, selector, k, weighted):
    groups = {}
    for nodes, edges, total in simple_paths(pairs, start, most):
        if len(edges) >= least:
            groups.setdefault(nodes[-1], []).append((total if weighted else float(len(edges)), len(edges), edges))
    ends = {}
    for node, paths in groups.items():
        paths.sort()
        ends[node] = [p for p in paths if p[0] == paths[0][0]] if selector == "ALL" else paths[: k if selector == "K" else 1]
    return sorted((node, p[2], p[0]) for node, paths in ends.items() for p in paths)


@pytest.mark.parametrize(("pairs", "least", "selector", "k", "weighted"), [
    (DETOUR, 1, "K", 2, False), (DETOUR, 2, "ANY", 1, False), (DETOUR, 3, "ALL", 1, True),
    (multigraph(1), 1, "K", 3, True), (multigraph(2), 2, "K", 2, False), (multigraph(3), 3, "ANY", 1, True),
])
def test_selectors_equal_brute_force(spark, pairs, least, selector, k, weighted):
    e = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "edge_id long, src long, dst long, w double")
    start = pairs[0][0]
    found = match.shortest(match.Edge("r", e, hops=(least, 5)), spark.createDataFrame([(start,)], "start long"), selector, k, "w" if weighted else None)
    assert sorted((r.node, r.edges, r.total_weight) for r in found.collect()) == expected(pairs, start, least, 5, selector, k, weighted)
