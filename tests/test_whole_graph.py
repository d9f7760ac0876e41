"""Queries over the whole graph, from every node, against brute force or DuckDB on the same tables."""

from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from skeinwork.plans import catalogue

DATA = "/root/testdata/sf0.001"


def shared_orders() -> Counter:
    orders = {}
    for order, supplier in duckdb.sql(f"SELECT l_orderkey, l_suppkey FROM '{DATA}/lineitem.parquet'").fetchall():
        orders.setdefault(order, []).append(supplier)
    return Counter(tuple(sorted(p)) for s in orders.values() for p in combinations(s, 2) if p[0] != p[1])


def test_co_supplied_holds_every_order(spark):
    got = {(r.src, r.dst): r.w for r in catalogue.edges(spark, DATA, "co_supplied").collect()}
    assert got == dict(shared_orders())


def test_eigenvector_scores_the_whole_graph(spark):
    pairs = shared_orders()
    ids = sorted({i for p in pairs for i in p})
    a = np.zeros((len(ids), len(ids)))
    for u, v in pairs:
        a[ids.index(u), ids.index(v)] = a[ids.index(v), ids.index(u)] = 1
    want = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = dict(catalogue.QUERIES["eigenvector"](spark, DATA).collect())
    assert [got[i] for i in ids] == pytest.approx((want / want.max()).tolist(), abs=1e-3)


@pytest.mark.parametrize("name", ["match_repeated_variable", "match_variable_length", "match_any_shortest_weighted", "match_shortest_k"])
def test_matches_from_every_node_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, DATA)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    first = set(con.sql(f"SELECT DISTINCT {want.columns[0]} FROM ({catalogue.ORACLE_SQL[name]}) t").fetchall())
    assert len(first) > 2


def test_all_paths_from_all_suppliers_equal_brute_force(spark):
    to = {}
    for (u, v), n in shared_orders().items():
        if n > 1:
            to.setdefault(u, []).append(v)
    want = Counter((a, b) for a in to for b in to[a]) + Counter((a, c) for a in to for b in to[a] for c in to.get(b, []) if c != a)
    assert Counter(map(tuple, catalogue.QUERIES["match_variable_length"](spark, DATA).collect())) == want
