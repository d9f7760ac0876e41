"""Operator 7: repeated passages, by paragraph MinHash banding and by content-anchored windows.

Every paragraph (a line; ``least_words`` lifts or sets a least length) goes through banding: paragraphs of
equal sets of 5-word shingles form a class, classes that share a band are joined, exact Jaccard similarity
of 0.8 or more confirms a link, and components of linked paragraphs are the groups of which the least
document's paragraphs stay. ``BANDS`` bands of ``ROWS`` coordinates miss a pair at the threshold with a
chance of (1 - 0.8**2)**6, below 0.3 %. Adjacent repeated paragraphs make up a passage; one of ``WORDS`` words
or more counts.

A passage may also begin and end within paragraphs. Winnowing finds those: the least shingle of any
``WINNOW`` consecutive ones is an anchor, so that any repeated run of ``WORDS`` words holds an anchor followed
by ``KEY_WORDS`` words of that run. Anchors whose key occurs in several documents are candidates; around
them every window of ``WORDS`` words is hashed, and a window that occurs in several documents is a repeated
passage, kept in the least document. Nothing is sampled.

A document is an id; its texts (one, unless rows repeat the id) are told apart by a hash, ``version``. Stored
tables are deleted as soon as the next one is written; texts move only where a comparison needs them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._kernels import U, distinct_sets, mix, set_digests, shingles, span_hashes, string_slices, window_hashes, words
from ._store import documents, drop, drop_part, fresh, join_hot, reclaim, sift, store, with_hint
from .near_dedup import band_keys, link_classes, source

WORDS = 51
WINNOW = 24
KEY_WORDS = WORDS - WINNOW + 1
PERCENT = 80
BANDS, ROWS = 6, 2
LEAST_WORDS = 1
BLOCK = 512  # paragraphs of a bucket that are compared at once
_FACTORS = mix(np.arange(101, 101 + KEY_WORDS, dtype=U)) | U(1)


def _sliding(x: np.ndarray, n: int, how: np.ufunc) -> np.ndarray:
    """``how`` over each run of ``n`` values, by doubling; run i starts at value i."""
    size = 1
    while 2 * size <= n:
        x = how(x[: len(x) - size], x[size:])
        size *= 2
    return how(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of the winnowed shingles that have a key's words after them."""
    owner, shingled = shingles(hashes, first)
    n = np.maximum(np.diff(first) - 4, 0)
    keep = np.flatnonzero(np.diff(first) >= WORDS)
    if not len(keep):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.cumsum(n) - n
    enough = np.zeros(len(n), dtype=bool)
    enough[keep] = True
    long = enough[owner[: int(n.sum())]]
    owner, shingled = owner[: int(n.sum())][long], shingled[: int(n.sum())][long]
    place = np.arange(int(n.sum()))[long] - at[owner]
    low = _sliding(shingled, WINNOW, np.minimum)
    low[owner[: len(low)] != owner[WINNOW - 1 :]] = 0
    edge = np.zeros(WINNOW - 1, dtype=U)
    best = _sliding(np.concatenate([edge, low, edge]), WINNOW, np.maximum)
    chosen = (best == shingled) & (place + KEY_WORDS <= np.diff(first)[owner])
    return owner[chosen], place[chosen]


def _anchor_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at), dtype=U)
    for k in range(KEY_WORDS):
        total += hashes[at + k] * _FACTORS[k]
    return mix(total).view(np.int64)


def _hashed(column: pa.Array):
    for at, data, offsets in string_slices(column):
        starts, ends, first = words(data, offsets)
        yield at, data, starts, ends, first, span_hashes(data, starts, ends)


def _lines(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first word of every line that has words, in all documents, and the number of words."""
    line = np.cumsum(data == 10)[starts]
    begin = np.zeros(len(starts), dtype=bool)
    begin[1:] = line[1:] != line[:-1]
    begin[first[:-1][np.diff(first) > 0]] = True
    return np.r_[np.flatnonzero(begin), len(starts)]


_MARK = "anchor boolean, id long, version long, start int, stop int, n_shingles int, set_a long, set_b long, keys array<long>"


def marks(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Of each text (id, version, text) its anchors (the key in set_a) and its paragraphs; start and stop count words."""
    names = [x.split(" ")[0] for x in _MARK.split(", ")]

    def run(batches):
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, data, starts, _, first, hashes in _hashed(batch.column(2)):
                owner, place = _anchors(hashes, first)
                n = len(owner)
                nothing = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(_anchor_keys(hashes, first[owner] + place)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, dtype=bool)), pa.array(ids[at + owner]), pa.array(versions[at + owner]), pa.array(place.astype(np.int32)), *nothing], names)
                if not len(starts):
                    continue
                begin = _lines(data, starts, first)
                sets = distinct_sets(*shingles(hashes, begin), len(begin) - 1)
                a, b = set_digests(*sets)
                owner = np.searchsorted(first, begin[:-1], side="right") - 1
                head = first[owner]
                columns = [
                    pa.array(np.zeros(len(owner), dtype=bool)), pa.array(ids[at + owner]), pa.array(versions[at + owner]), pa.array((begin[:-1] - head).astype(np.int32)),
                    pa.array((begin[1:] - head).astype(np.int32)), pa.array(np.diff(sets[1]).astype(np.int32)), pa.array(a), pa.array(b), band_keys(*sets, BANDS, ROWS),
                ]
                lines = pa.RecordBatch.from_arrays(columns, names)
                yield lines.filter(pa.array(np.diff(begin) >= least_words)) if least_words > 1 else lines

    return docs.mapInArrow(run, _MARK)


def _cut_lines(marked: DataFrame) -> DataFrame:
    """(id, text) of chosen paragraphs: ``marked`` has text and ``chosen``, an array of (start, stop, class)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            for at, data, starts, ends, first in _spelled(batch.column(0)):
                part = lists.slice(at, len(first) - 1)
                flat, owner = part.flatten(), np.repeat(np.arange(len(first) - 1), part.value_lengths().to_numpy())
                a, b = (first[owner] + flat.field(k).to_numpy() for k in (0, 1))
                raw = data.tobytes()
                text = [raw[x:y] for x, y in zip(starts[a].tolist(), ends[b - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field(2), pa.array(text, pa.binary()).cast(pa.string())], ["id", "text"])

    return marked.select("text", "chosen").mapInArrow(run, "id long, text string")


def _spelled(column: pa.Array):
    for at, data, offsets in string_slices(column):
        starts, ends, first = words(data, offsets)
        yield at, data, starts, ends, first


def repeated_paragraphs(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, version, start, stop, first_id): paragraphs whose component holds several documents.

    ``lines``: the paragraphs among :func:`marks` of ``docs``.
    """
    by_set = ["set_a", "set_b", "n_shingles"]
    classes = lines.groupBy(*by_set).agg(F.min(F.struct("id", "version", "start", "stop")).alias("rep"), F.max("id").alias("last"), F.count("*").alias("times"), F.first("keys").alias("keys"))
    classes = store(classes.select(F.monotonically_increasing_id().alias("class"), *by_set, "rep", "last", "times", "keys"), "classes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        reps = classes.join(wanted.withColumnRenamed("id", "class"), "class").select("rep.id", "rep.version", F.struct("rep.start", "rep.stop", "class").alias("line"))
        chosen = reps.groupBy("id", "version").agg(F.collect_list("line").alias("chosen"))  # the lines of one text
        found = docs.join(chosen, ["id", "version"]).groupBy("id", "version").agg(F.first("text").alias("text"), F.first("chosen").alias("chosen"))
        return _cut_lines(found)

    labels = link_classes(classes.select(F.col("class").alias("id"), "keys"), texts_of, PERCENT, block=BLOCK)
    placed = classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select(*by_set, "times", F.col("rep.id").alias("first_id"), "last", F.coalesce("component", "class").alias("component"))
    placed = store(placed, "placed")
    heads = placed.groupBy("component").agg(F.min("first_id").alias("first_id"), F.max("last").alias("last")).where("first_id < last").select("component", "first_id")
    repeated = store(placed.select("component", *by_set, "times").join(heads, "component").drop("component"), "repeated")
    drop(classes, labels, placed)
    return join_hot(lines.select("id", "version", "start", "stop", *by_set), repeated, by_set, "times", lines.count()).select("id", "version", "start", "stop", "first_id")


def passages(found: DataFrame, least: int = WORDS) -> DataFrame:
    """The repeated paragraphs that adjoin others, all of the least document or all not, to ``least`` words in all."""
    doc = Window.partitionBy("id", "version").orderBy("start")
    marked = found.withColumn("kept", F.col("id") == F.col("first_id"))
    begins = (F.lag("stop").over(doc) == F.col("start")) & (F.lag("kept").over(doc) == F.col("kept"))
    runs = marked.withColumn("begins", (~F.coalesce(begins, F.lit(False))).cast("int")).withColumn("run", F.sum("begins").over(doc))
    total = F.sum(F.col("stop") - F.col("start")).over(Window.partitionBy("id", "version", "run"))
    return runs.withColumn("total", total).where(F.col("total") >= least).select(*found.columns)


def windows(marked: DataFrame) -> DataFrame:
    """(hash, id, version, word) of every window of WORDS words around the anchors ``words`` of a text."""

    def run(batches):
        for batch in batches:
            ids, versions, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for at, _, _, _, first, hashes in _hashed(batch.column(2)):
                n = np.diff(first)
                part = lists.slice(at, len(n))
                places = part.flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), part.value_lengths().to_numpy())
                flags = np.zeros(len(hashes) + 1, dtype=np.int64)  # starts of windows that cover an anchor's key
                np.add.at(flags, first[owner] + np.maximum(places - (WINNOW - 1), 0), 1)
                np.add.at(flags, first[owner] + places + 1, -1)
                start = np.flatnonzero(np.cumsum(flags[:-1]) > 0)
                owner = np.searchsorted(first, start, side="right") - 1
                fits = start + WORDS <= first[owner + 1]
                start, owner = start[fits], owner[fits]
                hashed = window_hashes(hashes, WORDS)[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), pa.array(ids[at + owner]), pa.array(versions[at + owner]), pa.array((start - first[owner]).astype(np.int32))], ["hash", "id", "version", "word"]
                )

    return marked.select("id", "version", "text", "words").mapInArrow(run, "hash long, id long, version long, word int")


def repeated_windows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, version, start, stop, first_id): runs of words covered by windows that other documents hold too.

    ``marked``: the stored :func:`marks` of ``docs``, whose anchors are deleted on the way.
    """
    found = marked.where("anchor").select(F.col("set_a").alias("key"), "id", "version", F.col("start").alias("word"))
    keys = found.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("times")).where("a < b").select("key", "times")
    keys = store(keys, "keys")
    reclaim(docs.sparkSession)
    chosen = store(join_hot(found, keys, ["key"], "times", found.count()).groupBy("id", "version").agg(F.array_sort(F.collect_set("word")).alias("words")), "chosen")
    drop_part(marked, "anchor=true")
    drop(keys)
    hashed = store(windows(sift(docs, chosen, ["id", "version"]).join(chosen, ["id", "version"])), "windows")
    drop(chosen)
    shared = hashed.groupBy("hash").agg(F.min("id").alias("first_id"), F.max("id").alias("b"), F.count("*").alias("times")).where("first_id < b").select("hash", "first_id", "times")
    shared = store(shared, "shared")
    reclaim(docs.sparkSession)
    held = join_hot(hashed, shared, ["hash"], "times", hashed.count())
    runs = held.groupBy("id", "version", "first_id").agg(F.array_sort(F.collect_set("word")).alias("at")).select("id", "version", "first_id", F.explode(_runs("at")).alias("run"))
    out = store(runs.select("id", "version", "run.start", "run.stop", "first_id"), "runs")
    drop(hashed, shared)
    return out


def _runs(column: str) -> F.Column:
    """Sorted window starts as the runs of words that they cover."""
    at = F.col(column)
    heads = F.filter(F.transform(at, lambda x, i: F.struct(x.alias("x"), F.coalesce(x - F.get(at, i - 1) > WORDS, F.lit(True)).alias("new"))), lambda s: s["new"])
    tails = F.filter(F.transform(at, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(at, i + 1) - x > WORDS, F.lit(True)).alias("last"))), lambda s: s["last"])
    return F.zip_with(heads, tails, lambda a, b: F.struct(a["x"].alias("start"), (b["x"] + WORDS).alias("stop")))


def _repeats(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    docs = source(df, id_col, text_col).where("id is not null and length(text) > 0")
    marked = store(marks(docs, least_words), "marks", "anchor")
    near = store(passages(repeated_paragraphs(docs, marked.where("not anchor"))), "passages")
    drop_part(marked, "anchor=false")
    exact = repeated_windows(docs, marked)
    return near.withColumn("kind", F.lit("paragraph")).unionByName(exact.withColumn("kind", F.lit("window")))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per repeated passage of a document: ``id_col``, start, stop, first_doc_id, kind and removed.

    start and stop count the document's words. first_doc_id is the least document that holds the
    passage (kind "window") or whose paragraph is in its component (kind "paragraph"); passages of
    that document have removed = false, all others true. Paragraphs of fewer than ``least_words`` words are
    left out of the banding (by default none is). Documents without a repeated passage, null and empty
    texts and rows with a null id have no row. Rows that repeat an id count as one document, which
    repeats nothing of its own; each of its texts has its own rows, equal texts have one set. Very long
    texts are read whole. Ties (several documents that hold a passage) go to the least id. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    found = _repeats(df, id_col, text_col, least_words)
    return found.select(F.col("id").alias(id_col), "start", "stop", F.col("first_id").alias("first_doc_id"), "kind", (F.col("id") != F.col("first_id")).alias("removed"))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``df`` without the repeated passages' words that :func:`repeats` removes; all rows and columns stay."""
    key, version, starts, stops, hint = (fresh(df, f"_{name}") for name in ("span_id", "version", "starts", "stops", "hint"))
    spans = _repeats(df, id_col, text_col, least_words).where("id <> first_id").groupBy("id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = store(spans.select(F.col("id").alias(key), F.col("version").alias(version), F.transform("spans", lambda s: s["start"]).alias(starts), F.transform("spans", lambda s: s["stop"]).alias(stops)), "spans")
    text = F.col(text_col).cast("string")
    own_id, own_version = F.col(id_col).cast("long"), F.xxhash64(text)
    hinted = with_hint(df, [own_id, own_version], spans.select(key, version), hint)  # texts without a span stay where they are
    joined = hinted.where(hint).join(spans, (own_id == F.col(key)) & (own_version == F.col(version)), "left")

    @F.pandas_udf("string")
    def cut(text, starts, stops):
        out = []
        for t, a, b in zip(text, starts, stops, strict=True):
            if a is None or t is None:
                out.append(t)
                continue
            raw = t.encode()
            data = np.frombuffer(raw, dtype=np.uint8)
            begin, end, _ = words(data, np.array([0, len(data)]))
            pieces, done = [], 0
            for s, e in sorted(zip(a.tolist(), b.tolist(), strict=True)):
                lo, hi = int(begin[s]), int(end[e - 1])
                if lo > done:
                    pieces.append(raw[done:lo])
                done = max(done, hi)
            out.append(b"".join([*pieces, raw[done:]]).decode())
        return type(text)(out)

    edited = F.when(F.col(starts).isNull(), F.col(text_col)).otherwise(cut(text, F.col(starts), F.col(stops)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    changed = joined.withColumn(text_col, edited).select(*columns)
    rest = hinted.where(~F.col(hint)).withColumn(text_col, F.col(text_col).cast(changed.schema[text_col].dataType))
    return changed.union(rest.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
