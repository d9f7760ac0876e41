"""Databases, tables, edge types and indexes by name: DataFrames with the metadata that queries need."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL type names -> Spark types; unsigned ones are wider signed ones whose range is checked on writing.
TYPES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT64": "bigint",
    "UINT8": "smallint", "UINT16": "int", "UINT32": "bigint", "UINT64": "decimal(20,0)", "FLOAT": "float", "REAL": "float", "FLOAT32": "float", "DOUBLE": "double", "FLOAT64": "double",
    "DECIMAL": "decimal", "NUMERIC": "decimal", "BOOLEAN": "boolean", "BOOL": "boolean", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "STRING": "string", "BYTEA": "binary", "BLOB": "binary",
    "DATE": "date", "TIME": "bigint", "TIMESTAMP": "timestamp_ntz", "INTERVAL": "struct<months:bigint,micros:bigint>", "POINT": "struct<x:double,y:double>", "JSON": "string", "JSONB": "string",
    "UUID": "string", "EMBEDDING": "array<float>",
}
UNSIGNED = {"UINT8": (1 << 8) - 1, "UINT16": (1 << 16) - 1, "UINT32": (1 << 32) - 1, "UINT64": (1 << 64) - 1}


class CatalogError(ValueError):
    """A name that is missing or taken, or a constraint that a change would break."""


@dataclass
class ColumnMeta:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    primary: bool = False
    unique: bool = False
    autoincrement: bool = False
    embedding: tuple[int, tuple[str, ...], str] | None = None  # dimension, source columns, provider
    check: str | None = None
    references: tuple[str, str] | None = None

    @property
    def spark_type(self) -> str:
        base, _, rest = self.type.partition("(")
        kind = TYPES.get(base.strip().upper())
        if kind is None:
            raise CatalogError(f"unknown type {self.type!r}")
        return f"decimal({rest}" if kind == "decimal" and rest else "decimal(38,6)" if kind == "decimal" else kind


@dataclass
class Constraints:
    """What a table's definition says of several columns: unique groups, checks, and (columns, table, its columns)."""

    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[tuple[list[str], str, list[str]]] = field(default_factory=list)


@dataclass
class TableMeta:
    name: str
    columns: list[ColumnMeta]
    data: DataFrame
    constraints: Constraints = field(default_factory=Constraints)

    @property
    def pk(self) -> list[str]:
        return [c.name for c in self.columns if c.primary]

    def column(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name == name:
                return c
        raise CatalogError(f"no column {name!r} in {self.name!r}")


@dataclass
class EdgeTypeMeta:
    name: str
    source: str
    target: str
    properties: list[ColumnMeta]
    data: DataFrame


@dataclass
class IndexMeta:
    name: str
    table: str
    columns: list[str]
    kind: str = "BTREE"
    unique: bool = False
    cached: object = None


@dataclass
class Database:
    name: str
    tables: dict[str, TableMeta] = field(default_factory=dict)
    edges: dict[str, EdgeTypeMeta] = field(default_factory=dict)
    indexes: dict[str, IndexMeta] = field(default_factory=dict)


class Catalog:
    """All databases; names are case-sensitive."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.databases = {"demo": Database("demo"), "system": Database("system")}
        self.current = "demo"

    @property
    def db(self) -> Database:
        return self.databases[self.current]

    def use(self, name: str) -> None:
        """Make a database the current one: unqualified names mean its tables."""
        for t in self.db.tables:
            self.spark.catalog.dropTempView(t)
        self.current = name
        for t in self.db.tables.values():
            t.data.createOrReplaceTempView(t.name)

    def snapshot(self) -> dict[str, Database]:
        """All databases as they are now; the metadata is copied, the DataFrames are immutable."""

        def table(t: TableMeta) -> TableMeta:
            c = t.constraints
            return TableMeta(t.name, [replace(x) for x in t.columns], t.data, Constraints([list(u) for u in c.unique], list(c.checks), list(c.foreign)))

        return {
            name: Database(
                name, {n: table(t) for n, t in db.tables.items()},
                {n: EdgeTypeMeta(e.name, e.source, e.target, [replace(p) for p in e.properties], e.data) for n, e in db.edges.items()}, {n: replace(i, columns=list(i.columns)) for n, i in db.indexes.items()},
            )
            for name, db in self.databases.items()
        }

    def restore(self, databases: dict[str, Database]) -> None:
        """Put back what :meth:`snapshot` gave."""
        for t in self.db.tables:
            self.spark.catalog.dropTempView(t)
        self.databases = databases
        self.current = self.current if self.current in databases else "demo"
        for t in self.db.tables.values():
            t.data.createOrReplaceTempView(t.name)

    def table(self, name: str) -> TableMeta:
        if name not in self.db.tables:
            raise CatalogError(f"no table {name!r}")
        return self.db.tables[name]

    def edge(self, name: str) -> EdgeTypeMeta:
        if name not in self.db.edges:
            raise CatalogError(f"no edge type {name!r}")
        return self.db.edges[name]

    def register(self, name: str, data: DataFrame, pk: str | None = None) -> TableMeta:
        """Make an existing DataFrame a table."""
        columns = [ColumnMeta(n, {"timestamp_ntz": "TIMESTAMP", "array<float>": "EMBEDDING"}.get(t, t.upper()), nullable=n != pk, primary=n == pk) for n, t in data.dtypes]
        meta = self.db.tables[name] = TableMeta(name, columns, data)
        data.createOrReplaceTempView(name)
        return meta

    def register_edges(self, name: str, data: DataFrame, source: str, target: str) -> EdgeTypeMeta:
        """Make a DataFrame with src, dst and properties an edge type; edge_id is added where it is missing."""
        if "edge_id" not in data.columns:
            data = data.withColumn("edge_id", F.monotonically_increasing_id())
        props = [ColumnMeta(n, t.upper()) for n, t in data.dtypes if n not in ("edge_id", "src", "dst")]
        meta = self.db.edges[name] = EdgeTypeMeta(name, source, target, props, data.select("edge_id", "src", "dst", *[p.name for p in props]))
        return meta

    # ---------------------------------------------------------------- metadata as tables

    def show(self, what: str, name: str | None = None) -> DataFrame:
        """Rows of SHOW: databases, tables, columns, indexes, edge types, embeddings or providers."""
        from .vector.provider import PROVIDERS

        rows, schema = {
            "DATABASES": lambda: ([(d,) for d in sorted(self.databases)], "name string"),
            "TABLES": lambda: ([(t,) for t in sorted(self.db.tables)], "name string"),
            "COLUMNS": lambda: ([(c.name, c.type, c.nullable, c.primary, c.default) for c in self.table(name).columns], "name string, type string, nullable boolean, primary_key boolean, default string"),
            "INDEXES": lambda: ([(i.name, i.table, ",".join(i.columns), i.kind, i.unique) for i in self.db.indexes.values()], "name string, table string, columns string, kind string, unique boolean"),
            "EDGE TYPES": lambda: ([(e.name, e.source, e.target, ",".join(p.name for p in e.properties)) for e in self.db.edges.values()], "name string, source string, target string, properties string"),
            "EMBEDDINGS": lambda: ([(t.name, c.name, *c.embedding[:1], ",".join(c.embedding[1]), c.embedding[2]) for t in self.db.tables.values() for c in t.columns if c.embedding], "table string, column string, dimension int, source string, provider string"),
            "PROVIDERS": lambda: ([(p,) for p in sorted(PROVIDERS)], "name string"),
        }[what]()
        return self.spark.createDataFrame(rows, schema)

    def describe(self, name: str) -> DataFrame:
        return self.show("COLUMNS", name)

    def virtual(self, name: str) -> DataFrame:
        """The six metadata tables that clients of the wire protocol ask for."""
        make = self.spark.createDataFrame
        relations = [(16384 + i, t, kind) for i, (t, kind) in enumerate([(t, "r") for t in sorted(self.db.tables)] + [(i, "i") for i in sorted(self.db.indexes)])]
        oid = {t: o for o, t, _ in relations}
        return {
            "pg_database": lambda: make([(i + 1, d) for i, d in enumerate(sorted(self.databases))], "oid long, datname string"),
            "pg_namespace": lambda: make([(11, "pg_catalog"), (2200, "public")], "oid long, nspname string"),
            "pg_type": lambda: make([(i + 1, t.lower()) for i, t in enumerate(sorted(TYPES))], "oid long, typname string"),
            "pg_class": lambda: make([(o, t, 2200, k) for o, t, k in relations], "oid long, relname string, relnamespace long, relkind string"),
            "pg_attribute": lambda: make([(oid[t.name], c.name, i + 1, not c.nullable) for t in self.db.tables.values() for i, c in enumerate(t.columns)], "attrelid long, attname string, attnum int, attnotnull boolean"),
            "pg_index": lambda: make([(oid[i.name], oid.get(i.table), i.unique) for i in self.db.indexes.values()], "indexrelid long, indrelid long, indisunique boolean"),
        }[name]()
