"""Shortest paths by tasks that hold the edges, against all simple paths."""

import pytest
from test_k_shortest import DETOUR, expected, multigraph

from skeinwork.graph import held_paths, match


@pytest.mark.parametrize(("pairs", "least", "most", "selector", "k", "weighted"), [
    (multigraph(4), 1, 3, "ANY", 1, True), (multigraph(5), 0, 5, "ANY", 1, False), (multigraph(6), 1, 2, "K", 3, True),
    (multigraph(7), 0, 2, "K", 2, False), (multigraph(8), 1, 2, "ALL", 1, False), (DETOUR, 1, 2, "ALL", 1, True),
])
def test_no_path_is_shuffled_and_results_equal_brute_force(spark, monkeypatch, pairs, least, most, selector, k, weighted):
    monkeypatch.setattr(held_paths, "AT_ONCE", 3)
    e = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "edge_id long, src long, dst long, w double")
    start = pairs[0][0]
    found = match.shortest(match.Edge("r", e, hops=(least, most)), spark.createDataFrame([(start,)], "start long"), selector, k, "w" if weighted else None)
    assert sorted((r.node, r.edges, r.total_weight) for r in found.collect()) == expected(pairs, start, least, most, selector, k, weighted)
    assert all(r.nodes[0] == start and r.nodes[-1] == r.node and len(r.nodes) == len(r.edges) + 1 for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
