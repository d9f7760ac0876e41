"""All-pairs measures against brute force, in blocks of several sizes, and by joins where a graph can't be held."""

import random
from collections import defaultdict

import pytest

from skeinwork.graph import algorithms as A
from skeinwork.graph import allpairs

DRAW = random.Random(5)
PAIRS = [(i, i + 1) for i in range(100, 140)] + [(DRAW.randrange(60), DRAW.randrange(60)) for _ in range(150)] + [(7, 7), (500, 500)]


def frame(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "edge_id long, src long, dst long")


def brute(pairs):
    """{node: (far, reached, harmonic, betweenness)}"""
    to = defaultdict(set)
    for a, b in pairs:
        to[a] |= {b} - {a}
    everyone = {v for p in pairs for v in p}
    between, out = dict.fromkeys(everyone, 0.0), {}
    for s in everyone:
        depth, sigma, order = {s: 0}, defaultdict(float, {s: 1.0}), [s]
        for v in order:
            for w in to[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for v in reversed(order):
            delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in to[v] if depth[w] == depth[v] + 1)
            between[v] += delta[v] if v != s else 0
        out[s] = (sum(depth.values()), len(depth) - 1, sum(1 / d for d in depth.values() if d))
    return {v: (*x, between[v]) for v, x in out.items()}


@pytest.mark.parametrize("state", [1 << 21, 64])
def test_kernels_equal_brute_force(spark, monkeypatch, state):
    monkeypatch.setattr(allpairs, "STATE", state)
    monkeypatch.setattr(allpairs, "EDGES_AT_ONCE", 16)
    pairs = A._simple(frame(spark, PAIRS))
    graph, want = allpairs.held(pairs), brute(PAIRS)
    sums = {r.node_id: (r.far, r.reached, r.h) for r in allpairs.distance_sums(pairs, graph).collect()}
    c = defaultdict(float)
    for r in allpairs.dependencies(pairs, graph).collect():
        c[r.node] += r.c
    assert sums.keys() == want.keys()
    for v, x in want.items():
        assert (*sums[v], c[v]) == pytest.approx(x)


def test_a_graph_too_large_to_be_held_takes_joins(spark, monkeypatch):
    monkeypatch.setattr(allpairs, "HELD_EDGES", 0)
    got = {r.node_id: r.harmonic for r in A.harmonic(frame(spark, [(1, 2), (2, 3), (9, 9)])).collect()}
    assert got == pytest.approx({1: 1.5, 2: 1.0, 3: 0.0, 9: 0.0})


def test_long_ways_take_no_job_a_level(spark):
    """This chain has 400 levels, and a level used to be a job."""
    e = spark.range(400).selectExpr("id AS edge_id", "id AS src", "id + 1 AS dst")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    h = {r.node_id: r.harmonic for r in A.harmonic(e).collect()}
    assert h[0] == pytest.approx(sum(1 / d for d in range(1, 401))) and h[400] == 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 100
