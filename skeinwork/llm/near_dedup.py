"""Operator 8: near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One pass hashes every document's distinct 5-word shingles. Two permutations give all coordinates of a
signature: the first maps a shingle to a position of a fixed table, the second is that table, shifted
by one place for each coordinate; coordinate k is the least value at (position + k). Bands of ``ROWS``
coordinates are the candidates' keys.

Documents with equal shingle sets form one class (equal by two 64-bit digests and the set's size); only one
text of it is compared. A class has a number of its own, so rows that repeat an id with other texts are
compared too; classes that share an id are linked by it. In each band's
bucket all members are first compared to one centre, the member that shares most buckets, not to each
other. Buckets that hold more than one component after that are compared in full, in blocks of
bounded size inside tasks; pairs are never emitted. A link is confirmed on the full sets of both texts.

The chance that no band holds a pair of similarity 0.85 is (1 - 0.85**6)**32, below 3 in ten million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._kernels import band_hashes, circulant_signatures, circulant_table, set_digests, shingle_sets, string_slices
from ._store import documents, drop, reclaim, store

BANDS, ROWS = 32, 6
TABLE_BITS = 20
BLOCK = 128
_tables: dict[tuple[int, int], np.ndarray] = {}


def _table(bits: int, k: int) -> np.ndarray:
    if (bits, k) not in _tables:
        _tables[bits, k] = circulant_table(bits, k)
    return _tables[bits, k]


def band_keys(hashed: np.ndarray, first: np.ndarray, bands: int, rows: int) -> pa.Array:
    """The bands' keys of each set; null for an empty one."""
    n = np.diff(first)
    keys = band_hashes(circulant_signatures(hashed, first, _table(TABLE_BITS, bands * rows)), bands, rows)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
    return pc.if_else(pa.array(n > 0), lists, pa.scalar(None, lists.type))


def source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text); the version, a hash of the text, tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, version, n_shingles, two digests of the whole set, and the bands' keys (null for an empty set)."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in string_slices(batch.column(2)):
                hashed, first = shingle_sets(data, offsets)
                n = np.diff(first)
                a, b = set_digests(hashed, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(a), pa.array(b), band_keys(hashed, first, bands, rows)],
                    ["id", "version", "n_shingles", "set_a", "set_b", "keys"],
                )

    return docs.mapInArrow(run, "id long, version long, n_shingles long, set_a long, set_b long, keys array<long>")


def _sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, data, offsets in string_slices(column):
        hashed, first = shingle_sets(data, offsets)
        out.extend(hashed[a:b] for a, b in zip(first[:-1], first[1:], strict=True))
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def verify_stars(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` that link; ``texts`` has each id once."""

    def run(batches):
        for batch in batches:
            left, right = _sets(batch.column(2)), _sets(batch.column(3))
            keep = pa.array([_linked(a, b, percent) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    joined = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
    return joined.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def _block_links(ids: np.ndarray, sides: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join different components within one pair of blocks: a spanning forest of them."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = int(code.max()) + 1 if len(code) else 0
    for lo in range(0, width, 4096):
        has = (code >= lo) & (code < lo + 4096)
        dense = np.zeros((len(sets), min(4096, width - lo)), dtype=np.float32)
        dense[owner[has], code[has] - lo] = 1
        common += dense @ dense.T
    common = np.rint(common).astype(np.int64)
    good = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if sides.any():
        good &= sides[:, None] != sides[None, :]
    _, part = np.unique(labels, return_inverse=True)
    u, v = np.nonzero(np.triu(good & (part[:, None] != part[None, :]), 1))
    # of the links between components those that join two that are still apart: fewer than there are components
    while len(u):
        least = np.full(part.max() + 1, len(u))
        np.minimum.at(least, np.maximum(part[u], part[v]), np.arange(len(u)))
        chosen = least[least < len(u)]  # each component of a greater number links to one of a less: no cycles
        for i, j in zip(u[chosen], v[chosen], strict=True):
            yield int(ids[i]), int(ids[j])
        to = np.arange(part.max() + 1)
        to[np.maximum(part[u[chosen]], part[v[chosen]])] = np.minimum(part[u[chosen]], part[v[chosen]])
        while (to[to] != to).any():
            to = to[to]
        part = to[part]
        apart = part[u] != part[v]
        u, v = u[apart], v[apart]


def verify_blocks(members: DataFrame, texts: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links inside buckets that still hold several components; ``members``: key, id, component.

    A bucket's members are dealt into blocks by their id's hash; each pair of blocks is one group of
    bounded size (blocks of a bucket with n members: about n / ``block``), compared as one product of
    0/1 matrices over the shingles that occur twice. Buckets with the same members count once.
    """
    size = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mark2"))
    once = size.groupBy("n", "mark", "mark2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = members.join(once, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = dealt.select("key", "id", "component", "block", other).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "id", "component",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def run(batches):
        held: list[pa.RecordBatch] = []

        def found(group: pa.Table):
            group = group.combine_chunks()
            columns = [group.column(k).to_numpy() for k in ("id", "side", "component")]
            sets = _sets(group.column("text").combine_chunks())
            links = list(_block_links(*columns[:2], columns[2], sets, percent))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

        last = None
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if last is not None and groups[a] != last:
                    yield found(pa.Table.from_batches(held))
                    held = []
                last = groups[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield found(pa.Table.from_batches(held))

    joined = rows.join(texts, "id").select("group", "id", "component", "side", "text")
    return joined.repartition("group").sortWithinPartitions("group", "id").mapInArrow(run, "u long, v long")


def link_classes(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, more_links: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(id, component) of the classes (id, keys) that link with others, by candidates of equal keys.

    ``texts_of`` gives (id, text) for a table of ids; ``more_links`` (u, v) holds without a comparison.
    """
    keyed = classes.select("id", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = store(keyed.join(sizes, "key"), "crowded")
    weight = crowded.groupBy("id").agg(F.sum(F.log2("n")).alias("weight"))
    centres = crowded.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))
    stars = crowded.join(centres, "key").where("id <> centre").select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct()
    texts = store(texts_of(crowded.select("id").distinct()), "texts")
    reclaim(texts.sparkSession)
    links = store(verify_stars(stars, texts, percent), "stars")
    known = links if more_links is None else links.union(more_links)
    labels = components(known)
    members = crowded.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_keys = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b and n > 2").select("key")
    more = store(verify_blocks(members.join(open_keys, "key"), texts, percent, block), "blocks")
    drop(crowded, texts)
    if more.limit(1).count():
        old, labels = labels, components(known.union(more))
        drop(old)
    drop(links, more)
    return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_shingles, component_id and kept.

    Documents link if 100 * intersection >= ``percent`` * union of their sets of 5-word shingles.
    Null and empty texts have an empty set and link with nothing; so does a row with a null id, whose
    component is null and which is kept. Rows that repeat an id, with one text or several, share its
    component, and each text's links count for the id: each row is kept if the id is the component's
    least. Ties don't arise: a component's least id is one. Very long texts are compared whole. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    docs = source(df, id_col, text_col)
    signed = store(signatures(docs, bands, rows), "signatures")
    full = signed.where("keys is not null and id is not null")
    by_set = ["set_a", "set_b", "n_shingles"]
    classes = full.groupBy(*by_set).agg(F.min(F.struct("id", "version")).alias("rep"), F.first("keys").alias("keys"))
    classes = store(classes.select(F.monotonically_increasing_id().alias("class"), *by_set, "rep", "keys"), "classes")
    placed = store(signed.drop("keys").join(classes.select(*by_set, "class"), by_set, "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("class")).alias("class")), "placed")
    drop(signed)
    several = placed.where("class is not null").groupBy("id").agg(F.min("class").alias("u"), F.max("class").alias("w")).where("u <> w").select("id", "u")
    same_id = store(placed.where("class is not null").join(several, "id").where("class <> u").select("u", F.col("class").alias("v")).distinct(), "same_id")

    def texts_of(wanted: DataFrame) -> DataFrame:
        reps = classes.join(wanted.withColumnRenamed("id", "class"), "class").select("class", "rep.id", "rep.version")
        return docs.join(reps, ["id", "version"]).groupBy("id", "version").agg(F.first("class").alias("class"), F.first("text").alias("text")).select(F.col("class").alias("id"), "text")

    labels = link_classes(classes.select(F.col("class").alias("id"), "keys"), texts_of, percent, same_id)
    least = classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("component"), "rep.id")
    heads = least.groupBy("component").agg(F.min("id").alias("component_id"))
    found = store(least.select("class", "component").join(heads, "component").select("class", "component_id"), "found")
    drop(classes, labels, same_id)
    component = F.coalesce("component_id", "id")
    return placed.join(found, "class", "left").select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
