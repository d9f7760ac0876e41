import duckdb
import pytest
from pyspark.sql import functions as F

from skeinwork.catalog import CatalogError
from skeinwork.functions import scalars as S
from skeinwork.plans import catalogue
from skeinwork.plans.dialect import Engine
from skeinwork.text import bm25
from skeinwork.text.analyzer import analyze, stem
from skeinwork.vector import nearest, provider

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def e(spark):
    engine = Engine(spark)
    engine.sql("CREATE TABLE people (id INT PRIMARY KEY, name TEXT NOT NULL, age INT DEFAULT 30, info JSON, spot POINT, mail TEXT UNIQUE)")
    engine.sql("INSERT INTO people (id, name, age) VALUES (1, 'ann', 40), (2, 'bob', NULL), (3, 'cy', 25)")
    engine.sql("CREATE EDGE TYPE knows FROM people TO people (since INT)")
    engine.sql("LINK people TO people VIA knows VALUES (1, 2, 2001), (2, 3, 2002), (1, 2, 2003)")
    return engine


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", ["segment_revenue", "integer_division", "right_join", "full_join", "not_in_with_null", "window_range_ties", "window_over_aggregate", "except_rows", "offset_alone", "json_extract", "temporal_arithmetic", "match_two_hops", "match_repeated_variable", "nearest_l2_residual", "bm25_plain"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert columns == sorted(want.columns)

    def normal(rows):
        return sorted(tuple(str(round(v, 4)) if isinstance(v, float) else str(v) for v in r) for r in rows)

    mine = [tuple(r[c] for c in columns) for r in got.collect()]
    theirs = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalogue.ORACLE_SQL[name]}) t").fetchall()
    assert normal([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in mine]) == normal([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in theirs])


def test_insert_update_delete_and_constraints(e):
    assert values(e.sql("SELECT id, age FROM people ORDER BY age")) == [(3, 25), (1, 40), (2, None)]
    assert values(e.sql("INSERT INTO people (id, name) VALUES (4, 'dee') RETURNING id, age")) == [(4, 30)]
    for bad in ("INSERT INTO people (id, name) VALUES (1, 'x')", "INSERT INTO people (id) VALUES (9)"):
        with pytest.raises(CatalogError):
            e.sql(bad)
    assert values(e.sql("UPDATE people SET age = age + 1 WHERE age > 25")) == [(2,)]
    assert values(e.sql("DELETE FROM people WHERE age > 40")) == [(1,)]
    assert e.sql("SELECT count(*) FROM people").first()[0] == 3


def test_links_traverse_and_match(e):
    assert values(e.sql("TRAVERSE knows FROM people(1)").orderBy("node")) == [(2, 1), (3, 2)]
    assert values(e.sql("MATCH (a:people)-[r:knows WHERE since > 2001]->(b:people) RETURN a.name, r.since AS y").orderBy("y")) == [("bob", 2002), ("ann", 2003)]
    assert values(e.sql("MATCH p = ANY SHORTEST (a:people WHERE id = 1)-[r:knows]->+(b:people) WHERE b.id = 3 RETURN path_length(p) AS n, nodes(p) AS n2")) == [(2, "[1,2,3]")]
    assert values(e.sql("SELECT name FROM people WHERE id IN (MATCH (a:people)-[r:knows]->(b:people) RETURN b.id) ORDER BY name")) == [("bob",), ("cy",)]
    assert values(e.sql("UNLINK people(1) FROM people(2) VIA knows")) == [(1,)]
    assert values(e.sql("UNLINK people(1) FROM people(2) VIA knows WHERE since = 2003")) == [(1,)]
    with pytest.raises(CatalogError):
        e.sql("LINK people(1) TO people(99) VIA knows")


def test_schema_changes_and_metadata(e):
    e.sql("ALTER TABLE people ADD COLUMN city TEXT DEFAULT 'x'")
    e.sql("ALTER TABLE people RENAME COLUMN city TO town")
    assert e.sql("SELECT DISTINCT town FROM people").first()[0] == "x"
    e.sql("ALTER TABLE people DROP COLUMN town")
    with pytest.raises(CatalogError):
        e.sql("ALTER TABLE people DROP COLUMN id")
    assert values(e.sql("SHOW EDGE TYPES")) == [("knows", "people", "people", "since")]
    assert e.sql("DESCRIBE people").count() == 6
    assert e.sql("SELECT relname FROM pg_catalog.pg_class").count() == 1
    e.sql("BEGIN")
    e.sql("DELETE FROM people")
    e.sql("ROLLBACK")
    assert e.sql("SELECT count(*) FROM people").first()[0] == 3
    with pytest.raises(CatalogError):
        e.sql("DROP TABLE people")
    e.sql("DROP TABLE people CASCADE")
    assert values(e.sql("SHOW TABLES")) == []


def test_embedding_columns_and_nearest(e):
    e.sql("CREATE TABLE notes (id INT PRIMARY KEY, body TEXT, vec EMBEDDING(8, 'body', 'builtin'))")
    e.sql("INSERT INTO notes (id, body) VALUES (1, 'red apple'), (2, 'blue sky'), (3, 'red apple pie'), (4, NULL)")
    assert [r[0] for r in values(e.sql("SELECT id, _distance FROM notes WHERE NEAREST(vec, 2) TO 'red apple' ORDER BY _distance"))] == [1, 3]
    assert values(e.sql("SELECT id FROM notes WHERE NEAREST(vec, 1) TO 'red apple' AND id > 1")) == []
    e.sql("CREATE INDEX notes_text ON notes USING bm25 (body)")
    assert [r[0] for r in values(e.sql("SELECT id FROM notes WHERE MATCH(body) TO 'apples' ORDER BY _score DESC"))] == [1, 3]
    assert values(e.sql("SELECT id FROM notes WHERE body = $1 || $2", "blue", " sky")) == [(2,)]


def test_distances(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "id int, v array<float>")
    assert [(r.id, r._distance) for r in nearest.nearest(t, "v", 2, [1, 0], pk="id").collect()] == [(1, 0.0), (3, 0.0)]
    assert nearest.nearest(t, "v", 5, [1, 0], "L2", "id").collect()[-1]._distance == 2.0
    assert nearest.nearest(t, "v", 1, [0, 3], "DOT", "id").first()._distance == 3.0
    assert nearest.nearest(t, "v", 0, [1, 0]).count() == 0
    assert provider.builtin(["", "A b", "a B"], 4)[0] is None and provider.builtin(["A b"], 4) == provider.builtin(["a B"], 4)


def test_analyzer_and_ranking(spark):
    assert analyze("The Running dogs' hopes, über 7") == ["run", "dog", "hope", "über", "7"]
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "sky")] == ["caress", "poni", "relat", "hop", "sky"]
    t = spark.createDataFrame([(1, "dog dog cat"), (2, "cat"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r._score for r in bm25.match(t, "id", "text", "dogs").collect()}
    assert set(got) == {1} and bm25.index(t, "id", "text").n == 3


def test_scalars(spark):
    one = spark.range(1)
    end = F.lit("2024-01-31").cast("date")
    row = one.select(
        S.shift(end, S.interval(1, 0)).cast("string").alias("clamped"), S.shift_time(F.lit(0).cast("long"), S.interval(0, 60_000_000), -1).alias("wrapped"),
        S.json_get(F.lit('{"a":["x",null]}'), "a", 0).alias("quoted"), S.json_text(F.lit('{"a":["x",null]}'), "a", 0).alias("plain"), S.json_text(F.lit('{"a":["x",null]}'), "a", 1).alias("nil"),
        S.json_get(F.lit("{}"), "b").alias("none"), S.point_distance(S.to_point(F.lit("(0,0)")), S.to_point(F.lit("(3, 4)"))).alias("five"), S.trunc(F.lit(-2.7)).alias("t"),
        S.age(F.lit("2024-03-15").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")).alias("age"), S.to_interval(F.lit("1 year 2 days")).alias("iv"),
    ).first()
    assert row.clamped.startswith("2024-02-29") and row.wrapped == 86_340_000_000 and (row.quoted, row.plain, row.nil, row.none) == ('"x"', "x", "null", None)
    assert row.five == 5 and row.t == -2 and row.age.months == 2 and (row.iv.months, row.iv.micros) == (12, 2 * S.MICROS_A_DAY)
