import pytest
from pyspark.sql import functions as F

from skeinwork.graph import algorithms as A
from skeinwork.graph import match, traverse
from skeinwork.graph.registry import REGISTRY


def edges(spark, pairs, **props):
    rows = [(i, a, b, *[v[i] for v in props.values()]) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "edge_id long, src long, dst long" + "".join(f", {p} double" for p in props))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_traverse_excludes_the_start_and_takes_least_depths(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)])
    assert rows(traverse.traverse(e, 1), "node", "depth", "source") == [(2, 1, 1), (3, 1, 1), (4, 2, 3)]
    assert rows(traverse.traverse(e, 4, "IN", max_depth=1), "node") == [(3,)]
    assert rows(traverse.traverse(e, 2, "BOTH", max_depth=1), "node") == [(1,), (3,)]
    traced = {r.node: (r.path_nodes, r.path_edges) for r in traverse.traverse(e, 1, trace=True).collect()}
    assert traced[4] == ([1, 3, 4], [2, 4])


def test_traverse_edges_and_bounds(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 4)])
    assert rows(traverse.traverse_edges(e, 1, max_depth=2), "__from", "__to", "__depth") == [(1, 2, 1), (2, 1, 1), (2, 3, 2)]
    with pytest.raises(ValueError, match="visited"):
        traverse.traverse(e, 1, max_visited=2)


def test_shortest_path(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)])
    assert [tuple(r) for r in traverse.shortest_path(e, 1, 5).orderBy("hop").collect()] == [(1, 0), (2, 1), (3, 2), (5, 3)]
    assert rows(traverse.shortest_path(e, 1, 1)) == [(1, 0)]
    assert rows(traverse.shortest_path(e, 5, 1)) == []


def test_match_repeated_variable_and_paths(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 3)])
    t = spark.createDataFrame([(i,) for i in range(1, 4)], "id long")
    a, b = match.Node("a", t, "id"), match.Node("b", t, "id")
    out = match.match([a, b, a], [match.Edge("r", e), match.Edge("s", e)])
    assert rows(out, "a.id", "b.id") == [(1, 2), (2, 1), (3, 3)]
    starts = t.where("id = 1").select(F.col("id").alias("start"))
    found = match.paths(match.Edge("r", e, hops=(0, None)), b, starts)
    assert rows(found, "nodes") == [([1],), ([1, 2],), ([1, 2, 3],)]


def test_shortest_selectors_and_weights(spark):
    e = edges(spark, [(1, 2), (2, 4), (1, 3), (3, 4), (1, 4)], w=[1.0, 1.0, 1.0, 1.0, 5.0])
    starts = spark.createDataFrame([(1,)], "start long")
    to = lambda df: sorted((r.nodes, r.total_weight) for r in df.collect() if r.node == 4)
    assert to(match.shortest(match.Edge("r", e), starts)) == [([1, 4], 1.0)]
    assert to(match.shortest(match.Edge("r", e), starts, "ALL", weight="w")) == [([1, 2, 4], 2.0), ([1, 3, 4], 2.0)]
    assert len(to(match.shortest(match.Edge("r", e), starts, "K", 3))) == 3
    assert to(match.shortest(match.Edge("r", e, hops=(1, 1)), starts, "ANY", weight="w")) == [([1, 4], 5.0)]
    with pytest.raises(ValueError, match="negative"):
        match.shortest(match.Edge("r", e.withColumn("w", -F.col("w"))), starts, weight="w")


@pytest.mark.parametrize(("damping", "iterations", "expected"), [(0.85, 1, (0.14444444, 0.42777778, 0.42777778)), (0.5, 20, (0.23529412, 0.35294118, 0.41176471))])
def test_pagerank_of_a_chain(spark, damping, iterations, expected):
    got = dict(A.pagerank(edges(spark, [(1, 2), (2, 3)]), damping, iterations).collect())
    assert [got[i] for i in (1, 2, 3)] == pytest.approx(expected, abs=1e-5)


def test_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (7, 7), (9, 8)])
    assert dict(A.connected_components(e).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 8, 9: 8}
    assert rows(A.strongly_connected_components(e)) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (7, 7, 1), (8, 8, 1), (9, 9, 1)]


def test_centralities(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    b = dict(A.betweenness(e).collect())
    assert b == pytest.approx({1: 0.0, 2: 2 / 6, 3: 2 / 6, 4: 0.0})
    c = {r.node_id: r for r in A.closeness(e).collect()}
    assert c[1].closeness == pytest.approx(3 / 6) and c[4].closeness == 0 and c[1].reachable_count == 4
    assert dict((r.node_id, r.harmonic) for r in A.harmonic(e).collect())[1] == pytest.approx(1 + 1 / 2 + 1 / 3)
    star = edges(spark, [(1, 2), (1, 3), (1, 4)])
    v = {r.node_id: r.score for r in A.eigenvector(star).collect()}
    assert v[1] == pytest.approx(1) and v[2] == pytest.approx(1 / 3**0.5, abs=1e-4)


def test_triangles_and_communities(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 2), (4, 5), (5, 6), (6, 4), (3, 4)])
    t = {r.node_id: (r.triangles, r.degree, r.local_coefficient) for r in A.clustering_coefficient(e).collect()}
    assert t[1] == (1, 2, 1.0) and t[3] == (1, 3, pytest.approx(1 / 3))
    assert dict(A.triangle_count(e).collect()) == dict.fromkeys(range(1, 7), 1)
    c = dict(A.community_detect(e).collect())
    assert c[1] == c[2] == c[3] != c[4] == c[5] == c[6]


def test_registry_checks_names(spark):
    e = edges(spark, [(1, 2)])
    with pytest.raises(ValueError, match="parameter"):
        REGISTRY.call("pagerank", e, speed=1)
    with pytest.raises(ValueError, match="unknown algorithm"):
        REGISTRY.call("fame", e)
