"""Operator 10: document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs (lines, long ones cut into runs of ``RUN`` words) become 64-bit digests. A sketch
has three rows of cells; a digest enters one cell of each row and changes its count, the exclusive or
of its digests and of their check values. Sketches are grouped sums over (document, cell). Two versions'
sketches subtract cell by cell, common digests vanish, and peeling recovers the differing ones: a cell
with count 1 or -1 whose check fits holds one digest, which is taken out of its other cells, and so on. If
cells are left over, both versions are sketched again, larger: in parts by the digests' bits, so many that
a part has about ``LOAD`` digests, with twice the parts and other places at each further attempt. After
``ATTEMPTS`` of them the digests themselves are compared.

The next document in descending order of ids is found without a global sort: ids are dealt into
ranges by quantiles, a window orders each range, and the ranges' first documents, of which there are
at most ``RANGES``, are joined to the range before. The number of ranges follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import documents, store

RUN = 16
WIDTH = 8  # cells in each of the three rows of the sketch that is returned
LARGE, LOAD, ATTEMPTS = 32, 12, 3  # cells in a row of a part, digests that it should hold, larger attempts
RANGES, ROWS_A_RANGE = 1 << 16, 20_000
ROUNDS = 24
_UNIT = r"\S++(?:[^\S\n]++\S++){0,%d}+"


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_UNIT % (RUN - 1)), F.lit(0)), lambda p: F.xxhash64(p))))


def _place(key: str, j: int, width: int, salt: int) -> str:
    """SQL for a digest's cell in row ``j``."""
    bits = f"xxhash64({key}, {salt})" if salt else key
    return f"cast(shiftrightunsigned({bits}, {16 * j}) & {width - 1} as int)"


def cells(base: DataFrame, width: int, salt: int = 0, parts: str = "1") -> DataFrame:
    """(row, part, cell) with counts, keys and checks of the sketches of a, e and x: n0, k0, h0, n1, .. h2.

    ``base`` has row and the digests a, e and x; it should be dealt by row, then nothing moves here.
    """
    sides = ", ".join(f"transform({v}, k -> named_struct('s', {s}, 'k', k))" for s, v in enumerate("aex"))
    each = base.select("row", F.expr(f"cast({parts} as int)").alias("parts"), F.inline(F.expr(f"concat({sides})")))
    placed = ", ".join(f"{_place('k', j, width, salt)} + {j * width}" for j in range(3))
    part = f"cast(shiftrightunsigned(xxhash64(k, {100 + salt}), 3) & (parts - 1) as int)"
    entries = each.select("row", F.expr(part).alias("part"), "s", "k", F.expr("xxhash64(k, 7)").alias("h"), F.explode(F.expr(f"array({placed})")).alias("cell"))
    sums = []
    for s in range(3):
        here = F.col("s") == s
        sums += [F.sum(here.cast("int")).cast("int").alias(f"n{s}"), F.bit_xor(F.when(here, F.col("k")).otherwise(F.lit(0).cast("long"))).alias(f"k{s}"), F.bit_xor(F.when(here, F.col("h")).otherwise(F.lit(0).cast("long"))).alias(f"h{s}")]
    return entries.groupBy("row", "part", "cell").agg(*sums)


def difference(s: int) -> Column:
    """A cell of the sketch of a less that of e (1) or x (2); null if nothing is left in it."""
    return F.expr(f"if(n0 = n{s} and k0 = k{s} and h0 = h{s}, null, named_struct('c', cell, 'n', n0 - n{s}, 'k', k0 ^ k{s}, 'h', h0 ^ h{s}))")


def peel(left: str, width: int, salt: int = 0) -> str:
    """SQL for the number of differing digests recovered from subtracted cells (c, n, k, h); NULL if some can't be."""
    places = ", ".join(f"'p{j}', {_place('x.k', j, width, salt)} + {j * width}" for j in range(3))
    pure = f"array_distinct(transform(filter(t.cells, x -> abs(x.n) = 1 and x.h = xxhash64(x.k, 7)), x -> named_struct('k', x.k, 'n', x.n, 'h', x.h, {places})))"
    taken = f"transform(t.cells, x -> aggregate(pure, x, (y, d) -> if(x.c = d.p0 or x.c = d.p1 or x.c = d.p2, named_struct('c', y.c, 'n', y.n - d.n, 'k', y.k ^ d.k, 'h', y.h ^ d.h), y)))"
    step = f"transform(array({pure}), pure -> named_struct('cells', if(size(pure) = 0, t.cells, filter({taken}, y -> y.n <> 0 or y.k <> 0L or y.h <> 0L)), 'found', t.found + size(pure), 'going', size(pure) > 0))[0]"
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {left}, 'found', 0, 'going', size({left}) > 0), (t, r) -> if(t.going, {step}, t),
      t -> if(size(t.cells) = 0, t.found, null))"""


def _text(s: int) -> Column:
    """A cell of a sketch as text: its number, count and both exclusive ors; null if it is empty."""
    return F.when(F.expr(f"n{s} > 0 or k{s} <> 0L or h{s} <> 0L"), F.concat_ws("-", F.format_string("%02x", "cell"), F.hex(f"n{s}"), F.lower(F.hex(f"k{s}")), F.substring(F.lower(F.hex(f"h{s}")), 1, 8)))


def first_sketches(base: DataFrame) -> DataFrame:
    """(row, fingerprint, edited_fingerprint, got1, got2): the sketches of ``WIDTH`` and what their differences give."""
    found = cells(base, WIDTH).groupBy("row").agg(
        *[F.array_join(F.array_sort(F.collect_list(_text(s))), ".").alias(name) for s, name in ((0, "fingerprint"), (1, "edited_fingerprint"))],
        *[F.collect_list(difference(s)).alias(f"d{s}") for s in (1, 2)],
    )
    return found.select("row", "fingerprint", "edited_fingerprint", *[F.expr(peel(f"d{s}", WIDTH)).alias(f"got{s}") for s in (1, 2)])


def larger_sketches(base: DataFrame, attempt: int) -> DataFrame:
    """(row, got1, got2) of further attempts, in parts."""
    parts = f"shiftleft(1, cast(ceil(log2(greatest(1.0D, (size(a) + greatest(size(e), size(x))) / {LOAD}.0D))) as int) + {attempt - 1})"
    found = cells(base, LARGE, attempt, parts).groupBy("row", "part").agg(*[F.collect_list(difference(s)).alias(f"d{s}") for s in (1, 2)])
    peeled = found.select("row", *[F.expr(peel(f"d{s}", LARGE, attempt)).alias(f"got{s}") for s in (1, 2)])
    return peeled.groupBy("row").agg(*[F.when(F.count(f"got{s}") == F.count("*"), F.sum(f"got{s}")).cast("int").alias(f"got{s}") for s in (1, 2)])


def _likeness(a: str, b: str, differing: str) -> Column:
    """Common digests over all digests of both; 1 for two texts without any."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, (size({a}) + size({b}) - {differing}) / (size({a}) + size({b}) + {differing}))")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and ``next_text``: the following document's by descending id, the first's after the last.

    Rows with one id are ordered by text, descending; null ids come last.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = min(RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_A_RANGE))
    bounds = sorted({int(x) for x in docs.where("id is not null").approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)})
    coarse = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + coarse] for i in range(0, len(bounds), coarse)]  # a search in two steps, each over about the root of all bounds

    def below(values: Column, at: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= at))

    if bounds:
        at = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
        group = below(F.lit([g[0] for g in groups]).cast("array<bigint>"), at)
        place = F.transform(F.array(group), lambda g: F.when(g > 0, (g - 1) * coarse + below(F.get(F.lit([g + [g[-1]] * (coarse - len(g)) for g in groups]).cast("array<array<bigint>>"), g - 1), at)).otherwise(0))
        docs = docs.withColumn("range", F.get(place, F.lit(0)))
    else:
        docs = docs.withColumn("range", F.lit(0))
    order = [F.col("id").desc_nulls_last(), F.col("text").desc()]
    tops = docs.groupBy("range").agg(F.max("id").alias("id"))  # one row a range: at most RANGES
    heads = docs.drop("range").join(F.broadcast(tops), "id").groupBy("range").agg(F.max("text").alias("head"))
    lone = docs.where("id is null").groupBy("range").agg(F.max("text").alias("null_head"))
    heads = tops.join(heads, "range", "left").join(lone, "range", "left").select("range", F.coalesce("head", "null_head").alias("head"))
    names = tops.select("range").withColumn("one", F.lit(0))
    after = names.select("range", F.lag("range").over(Window.partitionBy("one").orderBy("range")).alias("below"), F.max("range").over(Window.partitionBy("one")).alias("top"))
    follow = after.select("range", F.coalesce("below", "top").alias("source")).join(heads.withColumnRenamed("range", "source"), "source").select("range", "head")
    led = docs.withColumn("led", F.lead("text").over(Window.partitionBy("range").orderBy(*order)))
    return led.join(follow, "range", "left").select("id", "text", F.coalesce("led", "head").alias("next_text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and peeled per row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next document in descending order of ids; rows that repeat an id follow one another by text, descending,
    and null ids come last. A null text is empty; two texts without words are alike (1) and their
    fingerprint is empty. Texts of equal paragraphs have equal fingerprints. A single document is its own next one.
    Very long texts are taken whole, in more parts. peeled says whether all differences came from sketches.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(df, id_col, text_col).withColumn("edited", edited)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("x"))
    base = store(rows, "digests")
    some = base.where("size(a) + size(e) + size(x) > 0").select("row", "a", "e", "x")
    first = store(first_sketches(some.repartition("row")), "sketches")
    tries = [first.select("row", "got1", "got2")]
    for attempt in range(1, ATTEMPTS + 1):
        failed = tries[-1].where("got1 is null or got2 is null").select("row")
        if failed.isEmpty():
            break
        tries.append(store(larger_sketches(some.join(failed, "row").repartition("row"), attempt), "sketches"))
    got = base.join(first, "row", "left")
    for k, other in enumerate(tries[1:]):
        got = got.join(other.withColumnsRenamed({"row": "row", "got1": f"got1_{k}", "got2": f"got2_{k}"}), "row", "left")
    for s in (1, 2):
        got = got.withColumn(f"found{s}", F.coalesce(f"got{s}", *[f"got{s}_{k}" for k in range(len(tries) - 1)], F.when(F.expr("size(a) + size(e) + size(x) = 0"), 0)))
    exact = "coalesce(found{i}, size(array_except(a, {v})) + size(array_except({v}, a)))"
    out = got.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        _likeness("a", "e", exact.format(i=1, v="e")).alias("near_edited"), _likeness("a", "x", exact.format(i=2, v="x")).alias("near_next"),
        F.expr("found1 is not null and found2 is not null").alias("peeled"),
    )
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
