"""Triangles by colours against brute force; no join makes a row a wedge."""

import random
from itertools import combinations

from skeinwork.graph import algorithms as A


def test_colours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "TRIANGLE_EDGES", 60)
    draw = random.Random(11)
    pairs = [(draw.randrange(30), draw.randrange(30)) for _ in range(150)] + [(0, i) for i in range(40, 90)]
    e = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "edge_id long, src long, dst long")
    have = {frozenset(p) for p in pairs}
    want = {v: 0 for p in pairs for v in p}
    for t in combinations(range(30), 3):
        if all(frozenset(x) in have for x in combinations(t, 2)):
            for v in t:
                want[v] += 1
    found = A.triangle_count(e)
    assert dict(found.collect()) == want
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
