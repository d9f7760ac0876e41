"""Changes of tables as new snapshots: INSERT, UPDATE, DELETE, links, and changes of schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import UNSIGNED, Catalog, CatalogError, ColumnMeta, Constraints, EdgeTypeMeta, IndexMeta, TableMeta
from ..sources.staging import staged
from ..vector.provider import backfill


def _publish(meta: TableMeta, data: DataFrame) -> None:
    meta.data = data
    data.createOrReplaceTempView(meta.name)


def _unique_sets(catalog: Catalog, meta: TableMeta) -> list[list[str]]:
    sets = ([meta.pk] if meta.pk else []) + meta.constraints.unique
    return sets + [[c.name] for c in meta.columns if c.unique and not c.primary] + [i.columns for i in catalog.db.indexes.values() if i.table == meta.name and i.unique]


def _checked(catalog: Catalog, meta: TableMeta, fresh: DataFrame, old: DataFrame | None, enforce: bool) -> None:
    """NOT NULL, ranges and uniqueness of new rows; CHECK and FOREIGN KEY only with ``enforce``."""
    for c in meta.columns:
        if (not c.nullable or c.primary) and not fresh.where(F.col(c.name).isNull()).isEmpty():
            raise CatalogError(f"NULL in {meta.name}.{c.name}")
        if (top := UNSIGNED.get(c.type.upper())) is not None and not fresh.where((F.col(c.name) < 0) | (F.col(c.name) > F.lit(top).cast("decimal(20,0)"))).isEmpty():
            raise CatalogError(f"value out of range in {meta.name}.{c.name}")
        if enforce and c.check and not fresh.where(f"NOT ({c.check})").isEmpty():
            raise CatalogError(f"CHECK of {meta.name}.{c.name} fails")
        if enforce and c.references:
            there = catalog.table(c.references[0]).data.select(F.col(c.references[1]).alias(c.name))
            if not fresh.where(F.col(c.name).isNotNull()).join(there, c.name, "left_anti").isEmpty():
                raise CatalogError(f"{meta.name}.{c.name} refers to a missing row")
    if enforce:
        for check in meta.constraints.checks:
            if not fresh.where(f"NOT ({check})").isEmpty():
                raise CatalogError(f"CHECK ({check}) of {meta.name} fails")
        for columns, table, keys in meta.constraints.foreign:
            there = catalog.table(table).data.select(*[F.col(k).alias(c) for c, k in zip(columns, keys, strict=True)])
            if not fresh.dropna(subset=columns).join(there, columns, "left_anti").isEmpty():
                raise CatalogError(f"{meta.name}.{columns} refers to a missing row")
    for key in _unique_sets(catalog, meta):
        some = fresh.dropna(subset=key)  # NULL keys never conflict
        if not some.groupBy(*key).count().where("count > 1").isEmpty() or old is not None and not some.join(old.select(*key), key, "left_semi").isEmpty():
            raise CatalogError(f"duplicate key {key} in {meta.name}")


def numbered(rows: DataFrame, name: str, after: int) -> DataFrame:
    """``rows`` with consecutive numbers from ``after`` + 1 on in the order of their partitions.

    Each partition is numbered by itself; the numbers of rows before it, one a partition, are broadcast.
    """
    place = "__place"
    rows = staged(rows.withColumn(place, F.monotonically_increasing_id()), "rows")
    part = F.shiftright(place, 33)
    counts = rows.groupBy(part.alias("__part")).agg((F.max(place) - F.shiftleft(F.shiftright(F.max(place), 33), 33) + 1).alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    out = rows.join(F.broadcast(before), part == F.col("__part"))
    return out.withColumn(name, F.col("__before") + F.col(place) - F.shiftleft(part, 33) + after + 1).drop(place, "__part", "__before")


def insert(catalog: Catalog, table: str, rows: DataFrame, columns: Sequence[str] | None = None, enforce: bool = False) -> DataFrame:
    """Append ``rows``; returns them as stored. Missing columns get their default, next number or NULL."""
    meta = catalog.table(table)
    names = list(columns or [c.name for c in meta.columns][: len(rows.columns)])
    if len(names) != len(rows.columns):
        raise CatalogError(f"{len(rows.columns)} values for {len(names)} columns")
    rows = rows.toDF(*names)
    out = []
    for c in meta.columns:
        if c.name in names:
            value = F.col(c.name).cast(c.spark_type)
        elif c.autoincrement:
            top = meta.data.agg(F.coalesce(F.max(c.name), F.lit(0)).alias("m")).first()["m"]
            rows = numbered(rows, "__number", top)
            value = F.col("__number").cast(c.spark_type)
        else:
            value = F.expr(c.default).cast(c.spark_type) if c.default is not None else F.lit(None).cast(c.spark_type)
        out.append(value.alias(c.name))
    fresh = rows.select(*out)
    for c in meta.columns:
        if c.embedding:
            fresh = backfill(fresh, c.name, c.embedding[0], c.embedding[1], c.embedding[2])
    fresh = staged(fresh, "insert")
    _checked(catalog, meta, fresh, meta.data, enforce)
    _publish(meta, meta.data.unionByName(fresh))
    return fresh


def update(catalog: Catalog, table: str, changes: dict[str, str], where: str | None = None, enforce: bool = False) -> DataFrame:
    """Set columns to SQL expressions over the old row; returns the rows changed."""
    meta = catalog.table(table)
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    new = {c: F.when(F.col("__hit"), F.expr(e).cast(meta.column(c).spark_type)).otherwise(F.col(c)).alias(c) for c, e in changes.items()}
    marked = staged(meta.data.withColumn("__hit", hit).select("__hit", *[new.get(c.name, F.col(c.name)) for c in meta.columns]), "update")
    data, changed = marked.drop("__hit"), marked.where("__hit").drop("__hit")
    _checked(catalog, meta, data, None, enforce)
    _publish(meta, data)
    return changed


def delete(catalog: Catalog, table: str, where: str | None = None) -> DataFrame:
    """Remove rows for which ``where`` is true; returns them."""
    meta = catalog.table(table)
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    gone = meta.data.where(hit)
    _publish(meta, meta.data.where(~hit))
    return gone


# ------------------------------------------------------------------ edges


def link(catalog: Catalog, edge: str, rows: DataFrame) -> int:
    """Append edges (src, dst, properties); every end must exist; all or nothing. Returns their number."""
    meta = catalog.edge(edge)
    names = ["src", "dst", *[p.name for p in meta.properties]]
    full = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(dict(meta.data.dtypes)[n]).alias(n) for n in names])
    for end, name in (("src", meta.source), ("dst", meta.target)):
        table = catalog.table(name)
        if not full.join(table.data.select(F.col(table.pk[0]).alias(end)), end, "left_anti").isEmpty():
            raise CatalogError(f"LINK {edge}: no such row in {name}")
    top = meta.data.agg(F.coalesce(F.max("edge_id"), F.lit(-1)).alias("m")).first()["m"]
    fresh = staged(numbered(full, "edge_id", top).select("edge_id", *names), "link")
    meta.data = meta.data.unionByName(fresh)
    return fresh.count()


def unlink(catalog: Catalog, edge: str, source: object, target: object, where: str | None = None) -> int:
    """Remove the first edge between two rows, or with ``where`` all that match it. Returns their number."""
    meta = catalog.edge(edge)
    hits = meta.data.where((F.col("src") == F.lit(source)) & (F.col("dst") == F.lit(target)))
    hits = hits.where(where) if where else hits.orderBy("edge_id").limit(1)
    gone = staged(hits.select("edge_id"), "unlink")
    meta.data = meta.data.join(gone, "edge_id", "left_anti")
    return gone.count()


# ------------------------------------------------------------------ schema


def create_table(catalog: Catalog, name: str, columns: list[ColumnMeta], if_not_exists: bool = False, constraints: Constraints | None = None) -> TableMeta:
    if name in catalog.db.tables:
        if if_not_exists:
            return catalog.table(name)
        raise CatalogError(f"table {name!r} exists")
    for c in columns:
        if c.autoincrement and (not c.primary or c.default is not None or c.spark_type not in ("tinyint", "smallint", "int", "bigint")):
            raise CatalogError("AUTOINCREMENT needs an integer primary key without DEFAULT")
    schema = ", ".join(f"`{c.name}` {c.spark_type}" for c in columns)
    meta = catalog.db.tables[name] = TableMeta(name, columns, catalog.spark.createDataFrame([], schema), constraints or Constraints())
    _publish(meta, meta.data)
    return meta


def drop_table(catalog: Catalog, name: str, if_exists: bool = False, cascade: bool = False) -> None:
    if name not in catalog.db.tables:
        if if_exists:
            return
        raise CatalogError(f"no table {name!r}")
    used = [e.name for e in catalog.db.edges.values() if name in (e.source, e.target)]
    if used and not cascade:
        raise CatalogError(f"edge types {used} use {name!r}")
    for e in used:
        del catalog.db.edges[e]
    for i in [i.name for i in catalog.db.indexes.values() if i.table == name]:
        del catalog.db.indexes[i]
    del catalog.db.tables[name]
    catalog.spark.catalog.dropTempView(name)


def add_column(catalog: Catalog, table: str, column: ColumnMeta) -> None:
    meta = catalog.table(table)
    if any(c.name == column.name for c in meta.columns):
        raise CatalogError(f"column {column.name!r} exists")
    if not column.nullable and column.default is None and not meta.data.isEmpty():
        raise CatalogError("a NOT NULL column without DEFAULT needs an empty table")
    value = F.expr(column.default) if column.default is not None else F.lit(None)
    meta.columns.append(column)
    _publish(meta, meta.data.withColumn(column.name, value.cast(column.spark_type)))


def drop_column(catalog: Catalog, table: str, name: str) -> None:
    meta = catalog.table(table)
    column = meta.column(name)
    if column.primary or len(meta.columns) == 1:
        raise CatalogError("a primary key or a last column can't be dropped")
    if any(name in group for group in [*meta.constraints.unique, *(c for c, _, _ in meta.constraints.foreign)]):
        raise CatalogError(f"a constraint of {table!r} names {name!r}")
    meta.columns.remove(column)
    _publish(meta, meta.data.drop(name))


def rename_column(catalog: Catalog, table: str, old: str, new: str) -> None:
    meta = catalog.table(table)
    if any(c.name == new for c in meta.columns):
        raise CatalogError(f"column {new!r} exists")
    meta.column(old).name = new
    meta.constraints.unique = [[new if c == old else c for c in group] for group in meta.constraints.unique]
    meta.constraints.foreign = [([new if c == old else c for c in group], t, keys) for group, t, keys in meta.constraints.foreign]
    _publish(meta, meta.data.withColumnRenamed(old, new))


def create_edge_type(catalog: Catalog, name: str, source: str, target: str, properties: list[ColumnMeta]) -> EdgeTypeMeta:
    if name in catalog.db.edges:
        raise CatalogError(f"edge type {name!r} exists")
    ends = [next(c.spark_type for c in catalog.table(t).columns if c.primary) for t in (source, target)]
    schema = f"edge_id long, src {ends[0]}, dst {ends[1]}" + "".join(f", `{p.name}` {p.spark_type}" for p in properties)
    meta = catalog.db.edges[name] = EdgeTypeMeta(name, source, target, properties, catalog.spark.createDataFrame([], schema))
    return meta


def create_index(catalog: Catalog, name: str, table: str, columns: list[str], kind: str = "BTREE", unique: bool = False) -> None:
    meta = catalog.table(table)
    if name in catalog.db.indexes:
        raise CatalogError(f"index {name!r} exists")
    if kind == "BM25" and (len(columns) != 1 or meta.column(columns[0]).spark_type != "string"):
        raise CatalogError("a BM25 index takes exactly one text column")
    for c in columns:
        meta.column(c)
    if unique and not meta.data.dropna(subset=columns).groupBy(*columns).count().where("count > 1").isEmpty():
        raise CatalogError(f"duplicate keys for {name!r}")
    catalog.db.indexes[name] = IndexMeta(name, table, columns, kind, unique)
