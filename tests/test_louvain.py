"""Louvain in arrays gives what the same moves give in dictionaries, and larger graphs get through."""

import random
from collections import defaultdict

from skeinwork.graph import algorithms as A


def louvain(pairs, resolution=1.0, max_iterations=10):
    everyone = sorted({v for p in pairs for v in p})
    graph = {v: defaultdict(float) for v in everyone}
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        graph[a][b] = graph[b][a] = 1.0
    member, total = {v: v for v in everyone}, sum(sum(x.values()) for x in graph.values())
    while total:
        home, strength = {v: v for v in graph}, {v: sum(x.values()) for v, x in graph.items()}
        inside = dict(strength)
        for _ in range(max_iterations):
            moved = False
            for v in sorted(graph):
                near = defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        near[home[u]] += w
                best = old = home[v]
                inside[old] -= strength[v]
                gain = near.get(old, 0.0) - resolution * strength[v] * inside[old] / total
                for c in sorted(near):
                    g = near[c] - resolution * strength[v] * inside[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                inside[best] += strength[v]
                home[v] = best
                moved |= best != old
            if not moved:
                break
        if all(v == c for v, c in home.items()):
            break
        member, merged = {v: home[c] for v, c in member.items()}, {c: defaultdict(float) for c in set(home.values())}
        for v, x in graph.items():
            for u, w in x.items():
                merged[home[v]][home[u]] += w
        graph = merged
    number: dict = {}
    return {v: number.setdefault(member[v], len(number)) for v in everyone}


def test_arrays_equal_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(A, "LOUVAIN_SLICE", 50)
    draw = random.Random(3)
    pairs = [(20 * (i % 5) + draw.randrange(20), 20 * (i % 5 if draw.random() < 0.8 else draw.randrange(5)) + draw.randrange(20)) for i in range(400)] + [(500, 500)]
    e = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "edge_id long, src long, dst long")
    assert dict(A.community_detect(e).collect()) == louvain(pairs)


def test_more_than_two_million_edges(spark):
    e = spark.range(2_100_000).selectExpr("id AS edge_id", "id % 30 AS src", "30 + id div 30 AS dst")
    assert len(A._neighbours(e.select("src", "dst"), A.np.arange(70_030))[1]) == 4_200_000 < 2 * A.LOUVAIN_EDGES
