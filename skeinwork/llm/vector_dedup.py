"""Operator 9: near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated into the order of their principal directions (an eigenbasis of the summed
outer products: one small matrix, from all rows). They are cut into tiles of about ``TILE_BYTES``, along the first
direction and, within a slab of it, by the signs of the next ones. An index, one row a tile, holds each
tile's box in the leading ``BOX`` directions; tiles whose boxes lie further apart than the threshold allows are
never paired. The pairs of one tile are dealt into groups of ``PARTNERS``, so that the tile itself travels once
for so many. Within a pair, blocks of ``BLOCK`` vectors whose boxes lie close enough are compared: products
of the leading dimensions are accumulated first; what the rest can add is bounded by the product of the
suffix norms, and only entries whose bound still reaches the threshold go on to the next dimensions.
Entries that remain are decided by the cosine of the original vectors in double precision. All of it is
exact: recall is 1. The work grows with the square of the rows, unless the boxes tell tiles apart.

Equal vectors form one class and are compared once. Each pair of tiles returns counts of links and a
spanning forest of its links, so that what leaves a task is linear in the tile; no pair list exists.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._store import drop, store

TILE_BYTES, BLOCK, PARTNERS = 1 << 22, 1024, 4
BOX, SIGNS, SLAB = 8, 6, 8  # directions of a box; those whose signs order a slab; tiles in a slab
_FINE = 64  # buckets for each unit of the first coordinate
LEADING = (16, 32, 64)
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring: huge and tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of the unit vectors' outer products: dim * dim numbers."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                x = _unit(_matrix(batch.column(0)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "value"])

    cells = vectors.select("embedding").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(dim * dim)
    for r in cells:
        out[r["cell"]] = r["value"]
    return out.reshape(dim, dim)


def principal_axes(moments: np.ndarray) -> np.ndarray:
    """Columns: orthonormal directions by descending share of the vectors' squared length."""
    values, axes = np.linalg.eigh(moments)
    return axes[:, np.argsort(-values, kind="stable")]


def links_between(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs whose cosine reaches the threshold.

    ``a``, ``b``: unit vectors; ``ra``, ``rb``: the same rotated. Leading dimensions come first, then
    only for entries whose product plus the suffix norms' product can still reach the threshold.
    """
    dim = ra.shape[1]
    cuts = [0, *[k for k in LEADING if k < dim], dim]
    products = ra[:, : cuts[1]] @ rb[:, : cuts[1]].T
    bound = products + np.outer(np.linalg.norm(ra[:, cuts[1] :], axis=1), np.linalg.norm(rb[:, cuts[1] :], axis=1))
    rows, columns = np.nonzero(bound >= threshold - _SLACK)
    if same:
        rows, columns = rows[rows < columns], columns[rows < columns]
    so_far = products[rows, columns]
    for lo, hi in zip(cuts[1:-1], cuts[2:], strict=True):
        if not len(rows):
            break
        parts = [np.einsum("ij,ij->i", ra[rows[i : i + 65536], lo:hi], rb[columns[i : i + 65536], lo:hi]) for i in range(0, len(rows), 65536)]
        so_far = so_far + np.concatenate(parts)
        rest = np.linalg.norm(ra[:, hi:], axis=1)[rows] * np.linalg.norm(rb[:, hi:], axis=1)[columns]
        keep = so_far + rest >= threshold - _SLACK
        rows, columns, so_far = rows[keep], columns[keep], so_far[keep]
    exact = [np.einsum("ij,ij->i", a[rows[i : i + 65536]], b[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)]
    keep = np.concatenate(exact) >= threshold if exact else np.zeros(0, dtype=bool)
    return rows[keep], columns[keep]


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least label of each node's component after hooking along the links until nothing changes."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _near_blocks(a: np.ndarray, b: np.ndarray, reach: float, same: bool):
    """Starts of the blocks of rotated vectors whose boxes lie within ``reach``."""

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(0, len(x), BLOCK)
        return at, np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)

    at_a, low_a, high_a = boxes(a)
    at_b, low_b, high_b = boxes(b)
    gap = np.maximum(0, np.maximum(low_b[None] - high_a[:, None], low_a[:, None] - high_b[None]))
    near = (gap**2).sum(axis=2) <= reach**2
    if same:
        near &= at_a[:, None] <= at_b[None]
    for i, j in zip(*np.nonzero(near), strict=True):
        yield int(at_a[i]), int(at_b[j])


def compare(ids: tuple, sizes: tuple, x: tuple, axes: np.ndarray, threshold: float, same: bool) -> pa.RecordBatch | None:
    """(id, n, other) for one pair of tiles: links of each vector in it, and a node of its component there."""
    unit = [_unit(v) for v in x]
    turned = [u @ axes for u in unit]
    shift, reach = 0 if same else len(ids[0]), math.sqrt(2 - 2 * threshold) + _SLACK
    nodes = ids[0] if same else np.concatenate(ids)
    n, ends = np.zeros(len(nodes)), []
    for i, j in _near_blocks(turned[0], turned[1], reach, same):
        p, q = slice(i, i + BLOCK), slice(j, j + BLOCK)
        u, v = links_between(unit[0][p], unit[1][q], turned[0][p], turned[1][q], threshold, same and i == j)
        if len(u):
            n += np.bincount(u + i, sizes[1][v + j], len(nodes)) + np.bincount(v + j + shift, sizes[0][u + i], len(nodes))
            some, at = np.unique(np.r_[u + i, v + j + shift], return_inverse=True)  # a spanning forest of the block's links
            label = _forest(at[: len(u)], at[len(u) :], len(some))
            ends.append(np.stack([some, some[label]]))
    if not ends:
        return None
    u, v = np.concatenate(ends, axis=1)
    label, some = _forest(u, v, len(nodes)), np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(n[some].astype(np.int64)), pa.array(nodes[label[some]])], ["id", "n", "other"])


def compare_tiles(rows: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """(id, n, other) of all pairs; ``rows`` hold each group's tile first, then its partners, part after part."""

    def run(batches):
        key, held, first = None, [], None

        def ended():
            """The tile that has been read: compared with the group's first one, or kept as such."""
            nonlocal first
            ids, sizes = (np.concatenate([np.frombuffer(r[c], dtype=np.int64) for r in held]) for c in ("ids", "sizes"))
            kind = np.float32 if sum(len(r["data"]) for r in held) == 4 * len(axes) * len(ids) else np.float64
            x = np.concatenate([np.frombuffer(r["data"], dtype=kind) for r in held]).astype(np.float64).reshape(len(ids), -1)
            if key[2] == 0:
                first = (key, ids, sizes, x)
                return None
            same = key[3] == first[0][3]
            return compare((first[1], ids), (first[2], sizes), (first[3], x), axes, threshold, same)

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["a"], r["chunk"], r["turn"], r["tile"])
                if key is not None and now != key:
                    if (found := ended()) is not None:
                        yield found
                    held = []
                key = now
                held.append(r)
        if held and (found := ended()) is not None:
            yield found

    return rows.mapInArrow(run, "id long, n long, other long")


def _one_dimension(classes: DataFrame, dim: int, threshold: float, tile: int | None) -> DataFrame:
    """(id, n, other) for the classes of one dimension."""
    axes = principal_axes(second_moments(classes, dim))
    tile = tile or max(256, TILE_BYTES // (8 * dim))
    part_rows = min(tile, max(1, (1 << 17) // (8 * dim)))
    signs, box = min(SIGNS, dim - 1), min(BOX, dim)

    def score(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(2))) @ axes if len(batch) else np.zeros((0, dim))
            cell = (x[:, 1 : 1 + signs] > 0) @ (1 << np.arange(signs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x[:, 0]), pa.array(cell.astype(np.int32))], ["rep", "size", "embedding", "first", "cell"])

    slabs = max(1, math.ceil(classes.count() / tile / SLAB))
    scored = classes.select("rep", "size", F.col("embedding").cast("array<double>")).mapInArrow(score, "rep long, size long, embedding array<double>, first double, cell int")
    dealt = scored.repartitionByRange(slabs, "first") if slabs > 1 else scored.coalesce(1)

    def pack(batches):
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 20, [], 0

        def packed():
            x = np.concatenate([_matrix(b.column(2)) for b in held])
            turned = (_unit(x) @ axes)[:, :box]
            ids, sizes = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            short = x.astype(np.float32)
            data = short if (short == x).all() else x
            low, high = turned.min(axis=0).tolist(), turned.max(axis=0).tolist()
            for k, at in enumerate(range(0, len(ids), part_rows)):
                rows = slice(at, at + part_rows)
                yield pa.RecordBatch.from_pylist([{"tile": number, "part": k, "low": low, "high": high, "ids": ids[rows].tobytes(), "sizes": sizes[rows].tobytes(), "data": data[rows].tobytes()}], schema)

        schema = pa.schema([("tile", pa.int64()), ("part", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            at = 0
            while at < len(batch):
                piece = batch.slice(at, min(tile - n, len(batch) - at))
                held.append(piece)
                at, n = at + len(piece), n + len(piece)
                if n == tile:
                    yield from packed()
                    number, held, n = number + 1, [], 0
        if held:
            yield from packed()

    blobs = store(dealt.sortWithinPartitions("cell", "first").mapInArrow(pack, "tile long, part int, low array<double>, high array<double>, ids binary, sizes binary, data binary"), "tiles")
    reach = math.sqrt(2 - 2 * threshold) + _SLACK  # unit vectors of such a cosine are no further apart in any direction
    index = blobs.where("part = 0").select("tile", "low", "high")
    a = index.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.expr(f"sequence(cast(floor(low[0] * {_FINE}) as int), cast(floor((high[0] + {reach}) * {_FINE}) as int))")).alias("bucket"))
    b = index.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.expr(f"cast(floor(low[0] * {_FINE}) as int)").alias("bucket"))
    gap = "aggregate(zip_with(zip_with(low_b, high_a, (x, y) -> x - y), zip_with(low_a, high_b, (x, y) -> x - y), (x, y) -> greatest(x, y, 0.0D)), 0.0D, (s, x) -> s + x * x)"
    pairs = a.join(b, "bucket").where(f"(low_a[0] < low_b[0] or low_a[0] = low_b[0] and a <= b) and {gap} <= {reach**2}")
    pairs = store(pairs.select("a", "b", F.expr(f"(row_number() over (partition by a order by b) - 1) div {PARTNERS}").cast("int").alias("chunk")), "pairs")
    groups = pairs.select("a", "chunk").distinct()
    wanted = groups.select("a", "chunk", F.lit(0).alias("turn"), F.col("a").alias("tile")).union(pairs.select("a", "chunk", F.lit(1), "b"))
    rows = wanted.join(blobs.select("tile", "part", "ids", "sizes", "data"), "tile").repartition(max(1, groups.count()), "a", "chunk").sortWithinPartitions("a", "chunk", "turn", "tile", "part")
    found = store(compare_tiles(rows, axes, threshold), "links")
    drop(blobs, pairs)
    return found


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tile: int | None = None) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id and kept.

    Vectors link if their cosine, in double precision, is at least ``threshold``; those of different
    lengths never do. A null or zero vector, or one with a null or non-finite component, links with
    nothing and is its own component. Equal vectors link with each other. A row with a null id links
    with nothing, has a null component and is kept; rows that repeat an id count as several vectors of
    one component. Very long vectors make smaller tiles (of ``tile`` vectors, by default as many as take
    ``TILE_BYTES``). An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    usable = F.expr("id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    vectors = vectors.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    classes = store(vectors.where("usable").groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("size")).select("rep", "size", "embedding"), "classes")
    found = None
    for row in classes.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():  # one row per vector length
        part = _one_dimension(classes.where(F.size("embedding") == row["dim"]), row["dim"], threshold, tile)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    labels = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    placed = classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    good = vectors.where("usable").join(placed, "embedding").select("id", "n_links", "component")
    rest = vectors.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return good.union(rest).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
