"""The registered queries of the engine and their SQL, by name."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import CatalogError
from ..functions import scalars
from ..graph import match, traverse
from ..sources.files import table
from ..text import bm25
from ..text.analyzer import STOP_WORDS
from ..vector import nearest, provider
from .dialect import Engine

FLAGSHIP = "segment_revenue"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "benchmark": "item_id", "pages": "page_id"}

VISITS = "SELECT event_id AS edge_id, user_id AS src, nxt AS dst FROM (SELECT event_id, user_id, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS nxt FROM events) w WHERE nxt IS NOT NULL"
#: Suppliers that share an order, weighted by the number of those orders.
CO_SUPPLIED = "SELECT a.l_suppkey * 1000000 + b.l_suppkey AS edge_id, a.l_suppkey AS src, b.l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey"
CONTAINS = "SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey AS src, l_partkey AS dst, l_quantity AS quantity, l_extendedprice AS price FROM lineitem"
PLACED = "SELECT o_orderkey AS edge_id, o_custkey AS src, o_orderkey AS dst FROM orders"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The test tables as a catalog with four edge types; nothing is read yet."""
    e = Engine(spark)
    for name in (*KEYS, "lineitem", "labels", "conversations"):
        e.catalog.register(name, table(spark, sf_dir, name), KEYS.get(name))
    e.catalog.register("users", spark.sql("SELECT DISTINCT user_id FROM events"), "user_id")
    for name, sql, source, target in (("visits", VISITS, "users", "users"), ("co_supplied", CO_SUPPLIED, "supplier", "supplier"), ("contains", CONTAINS, "orders", "part"), ("placed", PLACED, "customer", "orders")):
        e.catalog.register_edges(name, spark.sql(sql), source, target)
    return e


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One edge type's table, from the tables it is made of."""
    source, sql = {"visits": ("events", VISITS), "co_supplied": ("lineitem", CO_SUPPLIED), "contains": ("lineitem", CONTAINS), "placed": ("orders", PLACED)}[name]
    table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(sql)


def dialect(name: str, sql: str, oracle: str | None = "same") -> None:
    """Register a query of the dialect; its oracle is the same text unless another is given."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).sql(sql)
    if oracle is not None:
        ORACLE_SQL[name] = sql if oracle == "same" else oracle


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return function

    return keep


# ------------------------------------------------------------------ scans, projection, predicates

dialect("segment_revenue", "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 5")
dialect("seq_scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R')")
dialect("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
dialect("or_scan", "SELECT p_partkey, p_name FROM part WHERE p_size = 10 OR p_retailprice > 1900")
dialect("count_scan", "SELECT count(*) AS n FROM lineitem")
dialect("count_per_table", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part")
dialect("const_select", "SELECT 1 AS one, 'x' AS letter, -5 AS minus, TRUE AS yes")
dialect("like_case", "SELECT p_partkey, CASE WHEN p_type LIKE '%A%' THEN 'a' WHEN p_size < 10 THEN 'small' ELSE 'other' END AS kind, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS size_name FROM part WHERE p_name NOT LIKE '%x_'")
dialect("integer_division", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS m FROM orders")
dialect("three_valued_logic", "SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS neither FROM (SELECT o_orderkey % 2 = 0 AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS b FROM orders) t")
dialect("casts_concat", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) % 10 AS tens, o_orderstatus || '-' || o_orderpriority AS tag, CAST(o_orderdate AS DATE) AS day FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) - CAST(trunc(o_totalprice) AS BIGINT) % 10 AS tens, o_orderstatus || '-' || o_orderpriority AS tag, CAST(o_orderdate AS DATE) AS day FROM orders")
dialect("json_extract", "SELECT event_id, props ->> 'k' AS text_value, props -> 'missing' AS none FROM events", "SELECT event_id, props ->> 'k' AS text_value, CAST(NULL AS VARCHAR) AS none FROM events")
dialect("decimal_sum", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total, round(CAST(avg(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE), 3) AS tax FROM lineitem GROUP BY l_returnflag")

# ------------------------------------------------------------------ joins and subqueries

dialect("inner_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
dialect("left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
dialect("right_join", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders ON c_custkey = o_custkey")
dialect("full_join", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50")
dialect("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
dialect("comma_join", "SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey")
dialect("theta_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
dialect("in_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
dialect("not_in_null_aware", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
dialect("not_in_with_null", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END FROM orders)")
dialect("exists_join_inside", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49)")
dialect("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
dialect("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
dialect("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
dialect("with_chain", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, coalesce(n, 0) AS n FROM customer LEFT JOIN per ON c_custkey = o_custkey")

# ------------------------------------------------------------------ aggregation, windows, order, sets

dialect("group_by_expression", "SELECT l_linenumber % 3 AS third, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS first_day, max(l_quantity) AS most FROM lineitem GROUP BY l_linenumber % 3")
dialect("aggregate_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
dialect("distinct_aggregates", "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 6) AS a FROM orders GROUP BY o_orderstatus")
dialect("aggregate_in_case", "SELECT o_orderpriority, CASE WHEN sum(o_totalprice) BETWEEN 0 AND 1e9 THEN 'low' ELSE 'high' END AS level FROM orders GROUP BY o_orderpriority")
dialect("string_agg", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
dialect("window_ranks", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS nt FROM orders")
dialect("window_offsets", "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")
dialect("window_rows_frame", "SELECT l_orderkey, l_linenumber, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS 2 PRECEDING) AS c FROM lineitem")
dialect("window_range_ties", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, avg(p_retailprice) OVER (PARTITION BY p_brand) AS a FROM part", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS a FROM part")
QUERIES["window_range_ties"] = lambda spark, d: engine(spark, d).sql("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS a FROM part")
dialect("window_over_aggregate", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM orders GROUP BY o_custkey")
dialect("null_order_top", "SELECT k FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS k FROM orders) t ORDER BY k DESC LIMIT 20", "SELECT k FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS k FROM orders) t ORDER BY k DESC NULLS FIRST LIMIT 20")
dialect("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
dialect("offset_alone", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
dialect("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
dialect("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
dialect("intersect_rows", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
dialect("except_rows", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
dialect("select_distinct", "SELECT DISTINCT p_brand, p_size FROM part")

# ------------------------------------------------------------------ functions

dialect("string_functions", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name) AS n, substring(p_name, 2, 3) AS sub, replace(p_name, 'a', '_') AS rep, left(p_name, 2) AS l, right(p_name, 2) AS r, reverse(p_name) AS rev, repeat(p_brand, 2) AS twice, strpos(p_name, 'e') AS pos, trim('  x ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, concat(p_brand, '/', p_type) AS c FROM part")
dialect("math_functions", "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS DOUBLE) AS c, CAST(floor(p_retailprice) AS DOUBLE) AS f, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(exp(p_size / 10.0), 4) AS e, round(power(CAST(p_size AS DOUBLE), 2), 2) AS p, mod(p_size, 7) AS m FROM part")
dialect("null_functions", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), '-') AS s, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM orders")
dialect("date_functions", "SELECT event_id, CAST(date_part('year', ts) AS DOUBLE) AS y, CAST(date_part('month', ts) AS DOUBLE) AS m, CAST(date_trunc('month', ts) AS DATE) AS mon FROM events")


@query("temporal_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 90 MINUTE AS later, o_orderdate - INTERVAL 1 MONTH AS sooner, CAST(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01') AS BIGINT) AS micros FROM orders")
def _temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.shift(t, scalars.interval(1, 5_400_000_000)).alias("later"), scalars.shift(t, scalars.interval(1, 0), -1).alias("sooner"),
        scalars.between(t, F.lit("1995-01-01").cast("timestamp_ntz"))["micros"].alias("micros"),
    )


@query("point_distances", "SELECT p_partkey, round(sqrt((p_size - 3.0) * (p_size - 3.0) + (p_retailprice - 4.0) * (p_retailprice - 4.0)), 6) AS d FROM part")
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = scalars.point(F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.point_distance(here, scalars.point(F.lit(3), F.lit(4))), 6).alias("d"))


# ------------------------------------------------------------------ changes

@query("insert_update_delete", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'NEW'")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("INSERT INTO nation VALUES (100, 'NEW', 3)")
    e.sql("UPDATE nation SET n_name = upper(n_name) || '!' WHERE n_regionkey = 1")
    e.sql("DELETE FROM nation WHERE n_regionkey = 2")
    return e.sql("SELECT n_nationkey, n_name FROM nation")


@query("link_unlink", "SELECT (SELECT count(*) FROM orders) + 1 AS n")
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    first = e.sql("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1").first()
    e.sql(f"LINK customer({first.o_custkey}) TO orders({first.o_orderkey}) VIA placed")
    e.sql(f"LINK customer TO orders VIA placed VALUES ({first.o_custkey}, {first.o_orderkey})")
    e.sql(f"UNLINK customer({first.o_custkey}) FROM orders({first.o_orderkey}) VIA placed")
    return e.catalog.edge("placed").data.agg(F.count("*").alias("n"))


_NAMES = ", ".join(f"('{t}')" for t in sorted([*KEYS, "lineitem", "labels", "conversations", "users"]))
dialect("show_tables", "SHOW TABLES", f"SELECT name FROM (VALUES {_NAMES}) t(name)")
dialect("virtual_catalog", "SELECT relname, relkind FROM pg_catalog.pg_class", f"SELECT name AS relname, 'r' AS relkind FROM (VALUES {_NAMES}) t(name)")
dialect("explain_plan", "EXPLAIN SELECT count(*) FROM orders WHERE o_orderkey < 10", None)
dialect("explain_json", "EXPLAIN (FORMAT JSON) SELECT count(*) FROM orders", None)

# ------------------------------------------------------------------ graph

_START = "(SELECT min(user_id) FROM events)"
_BFS = f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({VISITS}) v), r(node, depth) AS (SELECT CAST({{start}} AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {{most}}), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) "
_PAIRS = f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({VISITS}) v WHERE src <> dst), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(o, node, depth) AS (SELECT id, id, 0 FROM n UNION SELECT r.o, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 8), m AS (SELECT o, node, min(depth) AS depth FROM r GROUP BY o, node) "


def _first_user(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.min("user_id").alias("u")).first()["u"]


@query("traverse_nodes", _BFS.format(start=_START, most=2) + "SELECT node, CAST(depth AS INTEGER) AS depth FROM m WHERE depth > 0")
def _traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("TRAVERSE visits FROM users($1) DIRECTION OUT MAX_DEPTH 2", _first_user(spark, sf_dir))


@query("traverse_from_source", _BFS.format(start=_START, most=2) + "SELECT node AS user_id, CAST(depth AS INTEGER) AS d FROM m WHERE depth > 1")
def _traverse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT t.user_id, t.__depth AS d FROM TRAVERSE visits FROM users($1) MAX_DEPTH 2 AS t WHERE t.__depth > 1", _first_user(spark, sf_dir))


@query("traverse_edges", _BFS.format(start=_START, most=1) + f"SELECT v.src AS \"__from\", v.dst AS \"__to\", CAST(greatest(a.depth, b.depth) AS INTEGER) AS \"__depth\", v.edge_id FROM ({VISITS}) v JOIN m a ON a.node = v.src JOIN m b ON b.node = v.dst")
def _traverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.traverse_edges(edges(spark, sf_dir, "visits"), _first_user(spark, sf_dir), max_depth=1)


@query("traverse_heterogeneous", "SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_orderkey = 1")
def _traverse_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT node FROM (TRAVERSE contains FROM orders(1)) AS t")


@query("traverse_correlated", f"SELECT DISTINCT src AS user_id FROM ({VISITS}) v WHERE src <> dst")
def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT u.user_id FROM users u WHERE EXISTS (TRAVERSE visits FROM users(u.user_id) MAX_DEPTH 1)")


@query("shortest_path_hops", _BFS.format(start=_START, most=8) + "SELECT depth + 1 AS n FROM m WHERE node = (SELECT max(user_id) FROM events)")
def _shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").agg(F.max("user_id").alias("u")).first()["u"]
    return engine(spark, sf_dir).sql("SELECT count(*) AS n FROM SHORTEST PATH FROM users($1) TO users($2) VIA visits", _first_user(spark, sf_dir), last)


dialect("match_two_hops", "MATCH (c:customer WHERE c.c_mktsegment = 'BUILDING')-[p:placed]->(o:orders)-[x:contains WHERE quantity > 40]->(t:part) WHERE o.o_totalprice > 100000 RETURN c.c_custkey, o.o_orderkey, t.p_partkey, x.quantity AS quantity, o.o_totalprice * 2 AS twice", "SELECT c_custkey, o_orderkey, p_partkey, l_quantity AS quantity, o_totalprice * 2 AS twice FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 40 AND o_totalprice > 100000")
dialect("match_incoming", "MATCH (t:part)<-[x:contains]-(o:orders) WHERE t.p_size < 20 RETURN t.p_partkey, o.o_orderkey", "SELECT l_partkey AS p_partkey, l_orderkey AS o_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 20")
dialect("match_repeated_variable", "MATCH (a:users)-[r:visits]->(b:users)-[s:visits]->(a) RETURN a.user_id AS a, b.user_id AS b", f"WITH v AS ({VISITS}) SELECT x.src AS a, x.dst AS b FROM v x JOIN v y ON x.dst = y.src AND y.dst = x.src")
dialect("match_shortest_k", "MATCH p = SHORTEST 2 (a:users)-[r:visits]->{1,2}(b:users) RETURN a.user_id AS a, b.user_id AS b, path_length(p) AS n", f"WITH v AS ({VISITS}), q AS (SELECT src AS a, dst AS b, 1 AS n FROM v WHERE src <> dst UNION ALL SELECT x.src, y.dst, 2 FROM v x JOIN v y ON x.dst = y.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst) SELECT a, b, CAST(n AS BIGINT) AS n FROM (SELECT a, b, n, row_number() OVER (PARTITION BY a, b ORDER BY n) AS k FROM q) t WHERE k <= 2")
dialect("match_in_subquery", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (MATCH (o:orders)-[x:contains]->(t:part) WHERE t.p_size = 7 RETURN o.o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7)")
dialect("match_correlated_exists", "SELECT c.c_custkey FROM customer c WHERE EXISTS (MATCH (a:customer)-[p:placed]->(o:orders) WHERE a.c_custkey = c.c_custkey AND o.o_totalprice > 300000 RETURN o.o_orderkey)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
@query("match_variable_length", f"WITH v AS (SELECT * FROM ({CO_SUPPLIED}) s WHERE w > 1) SELECT src AS a, dst AS b FROM v UNION ALL SELECT x.src, y.dst FROM v x JOIN v y ON y.src = x.dst AND y.dst <> x.src")
def _variable_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier over all orders; hops are bounded, so the number of paths is not."""
    suppliers, e = table(spark, sf_dir, "supplier"), edges(spark, sf_dir, "co_supplied")
    hop = match.Edge("r", e, "OUT", (1, 2), "w > 1")
    starts = suppliers.select(F.col("s_suppkey").alias("start"))
    return match.paths(hop, None, starts, max_paths=sys.maxsize).select(F.col("start").alias("a"), F.col("node").alias("b"))


_STEP = "SELECT s, node, min(total) AS total FROM (SELECT * FROM {0} UNION ALL SELECT {0}.s, v.dst, {0}.total + v.w FROM {0} JOIN v ON v.src = {0}.node) t GROUP BY s, node"


@query("match_any_shortest_weighted", f"WITH v AS ({CO_SUPPLIED}), h1 AS (SELECT src AS s, dst AS node, w AS total FROM v), h2 AS ({_STEP.format('h1')}), h3 AS ({_STEP.format('h2')}) SELECT s AS start, node, total AS total_weight FROM h3")
def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier over all orders."""
    e = edges(spark, sf_dir, "co_supplied")
    best = match.shortest(match.Edge("r", e, "OUT", (1, 3)), e.select(F.col("src").alias("start")).distinct(), "ANY", weight="w")
    return best.select("start", "node", "total_weight")


def _pagerank_sql(rounds: int) -> str:
    parts = [f"WITH v AS ({VISITS}), n AS (SELECT src AS id FROM v UNION SELECT dst FROM v), c AS (SELECT count(*) AS n FROM n), d AS (SELECT src, count(*) AS k FROM v GROUP BY src), p0 AS (SELECT id, 1.0 / (SELECT n FROM c) AS s FROM n)"]
    for i in range(rounds):
        parts.append(f"l{i} AS (SELECT coalesce(sum(s), 0) AS loose FROM p{i} WHERE id NOT IN (SELECT src FROM d)), g{i} AS (SELECT v.dst AS id, sum(p{i}.s / d.k) AS g FROM v JOIN p{i} ON p{i}.id = v.src JOIN d ON d.src = v.src GROUP BY v.dst), p{i + 1} AS (SELECT n.id, 0.15 / (SELECT n FROM c) + 0.85 * (coalesce(g, 0) + (SELECT loose FROM l{i}) / (SELECT n FROM c)) AS s FROM n LEFT JOIN g{i} ON g{i}.id = n.id)")
    return ", ".join(parts) + f" SELECT id AS node_id, round(s, 6) AS score FROM p{rounds}"


dialect("pagerank", "SELECT node_id, round(score, 6) AS score FROM pagerank('visits', iterations := 5)", _pagerank_sql(5))
dialect("connected_components", "SELECT * FROM connected_components('visits')", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({VISITS}) v), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, node) AS (SELECT src, src FROM b UNION SELECT r.id, b.dst FROM r JOIN b ON b.src = r.node) SELECT id AS node_id, min(node) AS component_id FROM r GROUP BY id")
dialect("strong_components", "SELECT * FROM strongly_connected_components('visits')", _PAIRS + ", k AS (SELECT a.o AS node_id, min(a.node) AS component_id FROM m a JOIN m b ON a.o = b.node AND a.node = b.o GROUP BY a.o) SELECT node_id, component_id, count(*) OVER (PARTITION BY component_id) AS component_size FROM k")
dialect("degree_centrality", "SELECT node_id, in_degree, out_degree, degree, round(normalized_degree, 6) AS nd FROM degree_centrality('visits')", f"WITH v AS ({VISITS}), n AS (SELECT src AS id FROM v UNION SELECT dst FROM v), i AS (SELECT dst AS id, count(*) AS k FROM v GROUP BY dst), o AS (SELECT src AS id, count(*) AS k FROM v GROUP BY src) SELECT n.id AS node_id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree, round((coalesce(i.k, 0) + coalesce(o.k, 0)) / ((SELECT count(*) FROM n) - 1.0), 6) AS nd FROM n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id")
dialect("closeness", "SELECT node_id, round(closeness, 6) AS closeness, reachable_count FROM closeness('visits')", _PAIRS + "SELECT o AS node_id, round(CASE WHEN sum(depth) > 0 THEN (count(*) - 1) / sum(depth) ELSE 0 END, 6) AS closeness, count(*) AS reachable_count FROM m GROUP BY o")
dialect("harmonic", "SELECT node_id, round(harmonic, 6) AS harmonic FROM harmonic('visits')", _PAIRS + "SELECT o AS node_id, round(sum(CASE WHEN depth > 0 THEN 1.0 / depth ELSE 0 END), 6) AS harmonic FROM m GROUP BY o")
_UNDIRECTED = f"WITH e AS (SELECT DISTINCT src, dst FROM ({VISITS}) v WHERE src <> dst), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS id FROM b UNION SELECT src FROM ({VISITS}) q UNION SELECT dst FROM ({VISITS}) z), t AS (SELECT x.src AS id, count(*) / 2 AS t FROM b x JOIN b y ON y.src = x.dst JOIN b z ON z.src = y.dst AND z.dst = x.src GROUP BY x.src), d AS (SELECT src AS id, count(*) AS k FROM b GROUP BY src) "
dialect("triangle_count", "SELECT * FROM triangle_count('visits')", _UNDIRECTED + "SELECT n.id AS node_id, CAST(coalesce(t, 0) AS BIGINT) AS triangle_count FROM n LEFT JOIN t ON t.id = n.id")
dialect("clustering_coefficient", "SELECT node_id, round(local_coefficient, 6) AS c, triangles, degree FROM clustering_coefficient('visits')", _UNDIRECTED + "SELECT n.id AS node_id, round(CASE WHEN coalesce(k, 0) > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS c, CAST(coalesce(t, 0) AS BIGINT) AS triangles, coalesce(k, 0) AS degree FROM n LEFT JOIN t ON t.id = n.id LEFT JOIN d ON d.id = n.id")
_SIGMA = ", ".join(f"s{d} AS MATERIALIZED (SELECT p.o, e.dst AS node, sum(p.s) AS s FROM s{d - 1} p JOIN e ON e.src = p.node JOIN m ON m.o = p.o AND m.node = e.dst AND m.depth = {d} GROUP BY p.o, e.dst)" for d in range(1, 9))
_SIGMA = ", s0 AS (SELECT o, node, CAST(1 AS DOUBLE) AS s FROM m WHERE depth = 0), " + _SIGMA + ", g AS MATERIALIZED (SELECT m.o, m.node, m.depth, s FROM m JOIN (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(9)) + ") z ON z.o = m.o AND z.node = m.node)"
dialect("betweenness", "SELECT node_id, round(centrality, 6) AS centrality FROM betweenness('visits')", _PAIRS + _SIGMA + f", every AS (SELECT src AS id FROM ({VISITS}) a UNION SELECT dst FROM ({VISITS}) b), c AS (SELECT x.node, sum(x.s * y.s / z.s) AS c FROM g x JOIN g y ON y.o = x.node AND y.depth > 0 JOIN g z ON z.o = x.o AND z.node = y.node AND z.depth = x.depth + y.depth WHERE x.depth > 0 GROUP BY x.node) SELECT id AS node_id, round(coalesce(c, 0) / greatest((SELECT (count(*) - 1.0) * (count(*) - 2) FROM every), 1), 6) AS centrality FROM every LEFT JOIN c ON c.node = id")
_POWER = ", ".join(f"x{k} AS MATERIALIZED (SELECT id, s / sqrt(sum(s * s) OVER ()) AS s FROM (SELECT p.id, p.s + coalesce(q.s, 0) AS s FROM x{k - 1} p LEFT JOIN (SELECT b.dst AS id, sum(x.s) AS s FROM b JOIN x{k - 1} x ON x.id = b.src GROUP BY b.dst) q ON q.id = p.id) r)" for k in range(1, 25))
dialect("eigenvector", "SELECT node_id, round(score, 3) AS score FROM eigenvector('co_supplied')", f"WITH e AS MATERIALIZED ({CO_SUPPLIED}), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), x0 AS (SELECT id, 1 / sqrt(count(*) OVER ()) AS s FROM (SELECT DISTINCT src AS id FROM b) n), {_POWER} SELECT id AS node_id, round(s / max(s) OVER (), 3) AS score FROM x24")
dialect("community_detect", "SELECT * FROM community_detect('visits')", None)

# ------------------------------------------------------------------ the dialect's own meaning

dialect("typed_division", "SELECT o_orderkey, (o_orderkey + o_custkey) / 2 AS half, abs(-o_orderkey) / 3 AS third, o_custkey * 7 / 2 / 3 AS chain, o_totalprice / 2 AS price FROM orders WHERE o_custkey / 10 > 3", "SELECT o_orderkey, (o_orderkey + o_custkey) // 2 AS half, abs(-o_orderkey) // 3 AS third, o_custkey * 7 // 2 // 3 AS chain, o_totalprice / 2 AS price FROM orders WHERE o_custkey // 10 > 3")
dialect("division_of_aggregates", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_nationkey, CAST(sum(n) / count(*) AS BIGINT) AS each FROM customer JOIN t ON c_custkey = o_custkey GROUP BY c_nationkey", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_nationkey, CAST(sum(n) // count(*) AS BIGINT) AS each FROM customer JOIN t ON c_custkey = o_custkey GROUP BY c_nationkey")
dialect("json_quoted_keys", """SELECT event_id, ('{"a.b": {"c d": ' || event_id || '}}') -> 'a.b' ->> 'c d' AS v FROM events""", "SELECT event_id, CAST(event_id AS VARCHAR) AS v FROM events")
dialect("json_functions", "SELECT p_partkey, json_array(p_size, p_brand, NULL) AS a, json_object('size', p_size, 'brand', p_brand) AS o, json_extract(json_object('k', json_array(p_size, 2)), '$.k') AS x FROM part", "SELECT p_partkey, '[' || p_size || ',\"' || p_brand || '\",null]' AS a, '{\"size\":' || p_size || ',\"brand\":\"' || p_brand || '\"}' AS o, '\"[' || p_size || ',2]\"' AS x FROM part")
dialect("numeric_functions", "SELECT p_partkey, trunc(p_retailprice) AS t, trunc(-p_retailprice / 7) AS m, round(log(p_retailprice), 6) AS l FROM part", "SELECT p_partkey, trunc(p_retailprice) AS t, trunc(-p_retailprice / 7) AS m, round(log10(p_retailprice), 6) AS l FROM part")
dialect("format_functions", "SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS d, to_char(o_orderkey, 'FM0000000') AS k, to_date(to_char(o_orderdate, 'DD/MM/YYYY'), 'DD/MM/YYYY') AS day, to_number(to_char(o_orderkey, 'FM0000000'), '0000000') AS n FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS k, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS DOUBLE) AS n FROM orders")
dialect("age_months", "SELECT o_orderkey, age(o_orderdate, TIMESTAMP_NTZ '1990-01-01').months AS months, age(o_orderdate, TIMESTAMP_NTZ '1990-01-01').micros AS micros FROM orders", "SELECT o_orderkey, datesub('month', TIMESTAMP '1990-01-01', o_orderdate) AS months, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01' + to_months(CAST(datesub('month', TIMESTAMP '1990-01-01', o_orderdate) AS INTEGER))) AS micros FROM orders")
dialect("typed_casts", "SELECT p_partkey, round(('(' || p_size || ', 2)')::POINT <-> '(0,0)'::POINT, 6) AS d, CAST(p_size || ' days 02:00:00' AS INTERVAL).micros AS micros, p_size::TEXT AS t FROM part", "SELECT p_partkey, round(sqrt(p_size * p_size + 4.0), 6) AS d, p_size * 86400000000 + 7200000000 AS micros, CAST(p_size AS VARCHAR) AS t FROM part")


@query("time_arithmetic", "SELECT o_orderkey, (o_orderkey * 7000000 + 82800000000) % 86400000000 AS t FROM orders")
def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = scalars.shift_time(F.lit(82_800_000_000).cast("long"), scalars.interval(0, F.col("o_orderkey") * 7_000_000))
    return table(spark, sf_dir, "orders").select("o_orderkey", late.alias("t"))


@query("insert_select_autoincrement", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT count(*) FROM nation) + 1, 'more'")
def _insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE names (id BIGINT PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL)")
    e.sql("INSERT INTO names (name) SELECT n_name FROM nation ORDER BY n_nationkey")
    e.sql("INSERT INTO names (name) VALUES ('more')")
    return e.sql("SELECT id, name FROM names")


@query("returning_rows", "SELECT n_nationkey, n_name || '?' AS n_name FROM nation WHERE n_regionkey = 3")
def _returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("UPDATE nation SET n_name = n_name || '?' WHERE n_regionkey = 3 RETURNING n_nationkey, n_name")


@query("alter_table", "SELECT r_regionkey, r_name AS title, 5 AS score FROM region")
def _altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    for change in ("ADD COLUMN score INT DEFAULT 5", "RENAME COLUMN r_name TO title", "ADD COLUMN gone TEXT", "DROP COLUMN gone"):
        e.sql(f"ALTER TABLE region {change}")
    return e.sql("SELECT * FROM region")


@query("table_constraints", "SELECT 2 AS n, TRUE AS refused")
def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE pairs (id INT, a INT, b INT, CONSTRAINT p PRIMARY KEY (id), UNIQUE (a, b))")
    e.sql("INSERT INTO pairs VALUES (1, 1, 1), (2, 1, 2)")
    refused = False
    try:
        e.sql("INSERT INTO pairs VALUES (3, 1, 2)")
    except CatalogError:
        refused = True
    return e.sql("SELECT CAST(count(*) AS INT) AS n, $1 AS refused FROM pairs", refused)


@query("two_databases", "SELECT 'other' AS base, 1 AS n UNION ALL SELECT 'demo', CAST(count(*) AS INTEGER) FROM region")
def _databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE DATABASE other")
    e.sql("USE other")
    e.sql("CREATE TABLE region (id INT PRIMARY KEY)")
    e.sql("INSERT INTO region VALUES (7)")
    e.sql("USE demo")
    return e.sql("SELECT 'other' AS base, CAST(count(*) AS INT) AS n FROM other.region UNION ALL SELECT 'demo', CAST(count(*) AS INT) FROM region")


@query("rolled_back", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'new'")
def _rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("BEGIN")
    e.sql("ALTER TABLE region ADD COLUMN more INT")
    e.sql("CREATE TABLE extra (id INT PRIMARY KEY)")
    e.sql("DELETE FROM region")
    e.sql("ROLLBACK")
    e.sql("INSERT INTO region VALUES (9, 'new')")
    return e.sql("SELECT * FROM region")


@query("traverse_trace", _BFS.format(start=_START, most=2) + "SELECT node, CAST(depth + 1 AS INTEGER) AS on_path FROM m WHERE depth > 0")
def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).sql("TRAVERSE visits FROM users($1) MAX_DEPTH 2 WITH TRACE", _first_user(spark, sf_dir))
    return found.select("node", F.size("__path.nodes").alias("on_path"))


dialect("match_all_shortest", "MATCH p = ALL SHORTEST (a:users)-[r:visits]->{1,2}(b:users) RETURN a.user_id AS a, b.user_id AS b, path_length(p) AS n", f"WITH v AS ({VISITS}), q AS (SELECT src AS a, dst AS b, 1 AS n FROM v WHERE src <> dst UNION ALL SELECT x.src, y.dst, 2 FROM v x JOIN v y ON x.dst = y.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst) SELECT a, b, CAST(n AS BIGINT) AS n FROM (SELECT a, b, n, rank() OVER (PARTITION BY a, b ORDER BY n) AS k FROM q) t WHERE k = 1")
dialect("closeness_wasserman_faust", "SELECT node_id, round(closeness, 6) AS closeness FROM closeness('visits', variant := 'wasserman_faust')", _PAIRS + f", every AS (SELECT src AS id FROM ({VISITS}) a UNION SELECT dst FROM ({VISITS}) b) SELECT o AS node_id, round(CASE WHEN sum(depth) > 0 THEN (count(*) - 1.0) / ((SELECT count(*) FROM every) - 1) * (count(*) - 1.0) / sum(depth) ELSE 0 END, 6) AS closeness FROM m GROUP BY o")

# ------------------------------------------------------------------ vectors and text

_QUERY = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
_VECTOR = "[" + ", ".join(map(str, _QUERY)) + "]"
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_VECTOR})[i]))"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_QNORM = sum(x * x for x in _QUERY) ** 0.5

dialect("nearest_cosine", f"SELECT vec_id, round(_distance, 6) AS d FROM embeddings WHERE NEAREST(embedding, 10) TO {_VECTOR} ORDER BY _distance", f"SELECT vec_id, round(1 - {_DOT} / ({_NORM} * {_QNORM!r}), 6) AS d FROM embeddings ORDER BY 1 - {_DOT} / {_NORM}, vec_id LIMIT 10".replace(f"ORDER BY 1 - {_DOT} / {_NORM}", f"ORDER BY 1 - {_DOT} / ({_NORM} * {_QNORM!r})"))
dialect("nearest_l2_residual", f"SELECT vec_id, label FROM embeddings WHERE NEAREST(embedding, 50) TO {_VECTOR} USING L2 AND label < 5", f"SELECT vec_id, label FROM (SELECT * FROM embeddings ORDER BY list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - ({_VECTOR})[i]) ** 2)), vec_id LIMIT 50) t WHERE label < 5")
dialect("nearest_dot", f"SELECT vec_id, round(_distance, 6) AS d FROM embeddings WHERE NEAREST(embedding, 7) TO {_VECTOR} USING DOT", f"SELECT vec_id, round({_DOT}, 6) AS d FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 7")
dialect("nearest_below_join", f"SELECT e.vec_id, d.lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE NEAREST(e.embedding, 20) TO {_VECTOR}", f"SELECT vec_id, lang FROM (SELECT vec_id FROM embeddings ORDER BY 1 - {_DOT} / ({_NORM} * {_QNORM!r}), vec_id LIMIT 20) e JOIN documents ON doc_id = vec_id")


@query("nearest_within_traverse", _BFS.format(start="(SELECT min(user_id) FROM events)", most=1) + f", s AS (SELECT node FROM m) SELECT vec_id FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT node FROM s) ORDER BY 1 - {_DOT} / ({_NORM} * {_QNORM!r}), vec_id LIMIT 5) t")
def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _first_user(spark, sf_dir)
    reached = traverse.traverse(edges(spark, sf_dir, "visits"), start, max_depth=1).select("node").union(spark.range(1).select(F.lit(start).cast("long")))
    return nearest.nearest(table(spark, sf_dir, "embeddings"), "embedding", 5, _QUERY, pk="vec_id", scope=reached).select("vec_id")


_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@query("bm25_plain", f"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x NOT IN ({_STOP})) AS terms FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM t), p AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM t), q AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN ('thtion', 'ouble') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM q GROUP BY term) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 3) AS score FROM q JOIN f USING (term), s GROUP BY doc_id")
def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.index(table(spark, sf_dir, "documents"), "doc_id", "text", stemming=False).search("Thtion, ouble the")
    return found.select(F.col("doc").alias("doc_id"), F.round(F.col("_score").cast("double"), 3).alias("score"))


@query("bm25_dialect")
def _bm25_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE INDEX docs_text ON documents USING bm25 (text)")
    return e.sql("SELECT doc_id, _score FROM documents WHERE MATCH(text) TO 'idiots and clowns' AND lang = 'en' ORDER BY _score DESC, doc_id LIMIT 20")


@query("embedding_provider")
def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "benchmark")
    return docs.select("item_id", provider.embed(F.col("text"), 8).alias("embedding"))

