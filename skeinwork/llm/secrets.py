"""Operator 1: secret scans with DataFrame functions only.

Base patterns (key assignments, access keys, long hex strings) are found by regular expressions. Their
places follow from the lengths of the matches and of the gaps between them: ``split`` by a pattern
gives the gaps, ``regexp_extract_all`` the matches.

Beyond those, long runs of key-like characters are candidates. A window slides over each; counts by
character change by the one that enters and the one that leaves, and so does the sum of c * log2(c), so
that the window's Shannon entropy is known at every step without counting again. The greatest one is
held against the threshold of the candidate's character class (hex or base 64); an allow-list (UUIDs,
placeholders, paths of plain words) suppresses harmless ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import documents, fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|placeholder|x{6}|^/?[a-z_-]+(?:/[a-z_-]+)*/?$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
HEX_BITS, BASE64_BITS = 3.0, 3.9
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[SECRET]"
_CHUNK = 64
_BLOCK = 4096
_SPAN = "struct<start:int,stop:int,rank:int,found:string>"


def _pairs(text: Column, pattern: str, kept: Column | None = None, gate: str | None = None) -> Column:
    """For each match: its length, that of the gap before it, whether it counts, and the match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    keep = F.transform(matches, lambda m: F.lit(True)) if kept is None else kept
    lengths = F.zip_with(F.split(text, pattern, -1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("found")))
    pairs = F.zip_with(lengths, keep, lambda p, k: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), k.alias("kept"), p["found"].alias("found")))
    pairs = F.filter(pairs, lambda p: p["size"].isNotNull())
    empty = F.expr("cast(array() as array<struct<gap:int,size:int,kept:boolean,found:string>>)")
    return F.when(text.rlike(gate or pattern), pairs).otherwise(empty)


def _spans(pairs: str, rank: int) -> Column:
    """The counted matches as (start, stop, rank, found), from lengths summed chunk by chunk."""
    sql = f"""
    transform(sequence(0, greatest(size({pairs}) - 1, 0) div {_CHUNK}), c -> aggregate(
      slice({pairs}, c * {_CHUNK} + 1, {_CHUNK}),
      named_struct('at', 0, 'spans', cast(array() as array<{_SPAN}>)),
      (s, p) -> named_struct('at', s.at + p.gap + p.size, 'spans', if(p.kept,
        concat(s.spans, array(named_struct('start', s.at + p.gap, 'stop', s.at + p.gap + p.size, 'rank', {rank}, 'found', p.found))), s.spans))))
    """
    shifted = f"""
    aggregate({sql}, named_struct('at', 0, 'parts', cast(array() as array<array<{_SPAN}>>)),
      (s, c) -> named_struct('at', s.at + c.at, 'parts', concat(s.parts, array(transform(c.spans, x -> named_struct('start', x.start + s.at, 'stop', x.stop + s.at, 'rank', x.rank, 'found', x.found))))),
      s -> flatten(s.parts))
    """
    return F.expr(shifted)


def entropy(found: Column) -> Column:
    """The greatest Shannon entropy, in bits, of any window of ``WINDOW`` characters of a string."""
    codes = F.transform(F.split(found, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def part(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.0)

    def step(s: Column, i: Column, all_codes: Column) -> Column:
        new = F.get(all_codes, i)
        old = F.when(i >= WINDOW, F.get(all_codes, i - WINDOW)).otherwise(-1)
        grown = F.get(s["counts"], new)
        shrunk = F.get(s["counts"], old)
        gain = F.when(new == old, 0.0).otherwise(part(grown + 1) - part(grown) + F.when(old >= 0, part(shrunk - 1) - part(shrunk)).otherwise(0.0))
        counts = F.transform(s["counts"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int"))
        bits = F.when(i >= WINDOW - 1, math.log2(WINDOW) - (s["total"] + gain) / WINDOW).otherwise(0.0)
        return F.struct(counts.alias("counts"), (s["total"] + gain).alias("total"), F.greatest(s["best"], bits).alias("best"))

    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    best = F.transform(F.array(codes), lambda a: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), zero, lambda s, i: step(s, i, a), lambda s: s["best"]))
    return F.get(best, F.lit(0))


def _stops_before(spans: str, only: str = "true") -> str:
    """SQL for the greatest stop of all spans before each one (of those that ``only`` holds for, as s), or -1.

    Spans are taken in chunks, so that time grows with their number and not with its square.
    """
    chunks = f"transform(sequence(0, greatest(size({spans}) - 1, 0) div {_CHUNK}), c -> slice(transform({spans}, s -> if({only}, s.stop, -1)), c * {_CHUNK} + 1, {_CHUNK}))"
    return f"""
    transform(array({chunks}), chunks -> transform(array(transform(chunks, x -> coalesce(array_max(x), -1))), tops ->
      flatten(transform(chunks, (x, c) -> transform(array(if(c = 0, -1, array_max(slice(tops, 1, c)))), before ->
        transform(x, (y, i) -> greatest(before, if(i = 0, -1, array_max(slice(x, 1, i))))))[0])))[0])[0]"""


def _with_spans(df: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``df`` with one more column, an array of (start, stop, rank, found), and that column's name."""
    assign, access, hexes, like, every, before, out = (fresh(df, f"_{x}") for x in ("assign", "access", "hex", "like", "every", "before", "spans"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long_value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    key_like = (
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
        lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(ALLOWED) & (entropy(m) >= F.when(m.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(BASE64_BITS)),
    )
    found = df.withColumns({
        assign: _pairs(text, ASSIGN, long_value, "(?i)password|passwd|secret|token|api_?key"),
        access: _pairs(text, ACCESS),
        hexes: _pairs(text, HEX),
        like: _pairs(text, CANDIDATE, F.transform(*key_like)),
    })
    found = found.withColumn(every, F.array_sort(F.concat(_spans(assign, 0), _spans(access, 1), _spans(hexes, 2), _spans(like, 3))))
    found = found.withColumn(before, F.expr(_stops_before(every, "s.rank < 3")))
    # an entropy span counts if base spans leave free a window's length of it at one end; bases that begin in it follow it
    inside = f"filter(slice({every}, i + 2, s.stop - s.start), b -> b.rank < 3 and b.start < s.stop)"
    free = f"""transform(array({inside}), n -> greatest(
      coalesce(array_min(transform(n, b -> b.start)), s.stop) - greatest(s.start, {before}[i]),
      s.stop - greatest(s.start, {before}[i], coalesce(array_max(transform(n, b -> b.stop)), 0))))[0]"""
    kept = f"filter({every}, (s, i) -> s.rank < 3 or {free} >= {WINDOW})"
    return found.withColumn(out, F.expr(f"if(exists({every}, s -> s.rank = 3), {kept}, {every})")).drop(assign, access, hexes, like, every, before), out


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one more, last column: an array of (start, stop, rank, found), by start, stop and rank.

    The column is ``_spans``, or with further underscores if ``df`` has a column of that name; all others stay
    as they are. rank is the kind's place in KINDS. Places count code points, stops are exclusive. Of one kind
    the leftmost match counts; spans of different kinds may overlap. An entropy span counts if the others leave
    free at least ``WINDOW`` characters of it at one end. A null text counts as empty and has no spans; equal
    texts have equal ones; an empty table stays empty. Very long texts take time in proportion to their length
    and number of spans. No shuffle.
    """
    return _with_spans(df, text_col)[0]


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])))


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans and n_entropy.

    base_sha256 digests the base spans as kind:start:stop, comma-joined, by start, then kind; spans has all of
    them. A text without spans, or null, has the digest of the empty string and empty spans. Repeated rows
    give repeated results; a null id stays null; an empty table gives an empty result; other columns are
    ignored, whatever their names. Very long texts are scanned whole (see :func:`scan`).
    """
    found, name = _with_spans(df.select(F.col(id_col), F.col(text_col)), text_col)
    by_kind = F.transform(F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop")))), lambda s: s)
    narrow = found.select(F.col(id_col).alias("id"), by_kind.alias("spans"))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    return narrow.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(3).alias("n_entropy"))


def redact(df: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by ``mask``; overlapping spans by one mask.

    Null texts stay null; all rows and columns stay, whatever their names; a text without secrets stays as it
    is. Equal texts have equal results. Very long texts are cut up once, in blocks, and put together again.
    """
    found, spans = _with_spans(df, text_col)
    before, runs, blocks = (fresh(found, f"_{x}") for x in ("before", "runs", "blocks"))
    text, some = F.col(text_col).cast("string"), F.size(spans) > 0
    # a span begins a masked run if it starts past all stops before it; the run ends at the greatest stop before the next
    found = found.withColumn(before, F.when(some, F.expr(_stops_before(spans))))
    heads = f"filter(zip_with({spans}, {before}, (s, p) -> named_struct('start', s.start, 'p', p)), x -> x.start > x.p)"
    last = f"array_max(transform({spans}, s -> s.stop))"
    found = found.withColumn(runs, F.when(some, F.expr(f"transform(array({heads}), h -> transform(h, (x, i) -> named_struct('start', x.start, 'stop', coalesce(get(h, i + 1).p, {last}))))[0]")))
    found = found.withColumn(blocks, F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))))
    piece = f"""if(a div {_BLOCK} = b div {_BLOCK}, substring(coalesce(get({blocks}, cast(a div {_BLOCK} as int)), ''), a % {_BLOCK} + 1, b - a), concat(
      substring(get({blocks}, cast(a div {_BLOCK} as int)), a % {_BLOCK} + 1), array_join(slice({blocks}, cast(a div {_BLOCK} + 2 as int), cast(b div {_BLOCK} - a div {_BLOCK} - 1 as int)), ''),
      coalesce(substring(get({blocks}, cast(b div {_BLOCK} as int)), 1, b % {_BLOCK}), '')))"""
    ends = f"transform(sequence(0, size({runs})), i -> named_struct('a', if(i = 0, 0, get({runs}, i - 1).stop), 'b', coalesce(get({runs}, i).start, length(`{text_col}`))))"
    pieces = F.expr(f"transform({ends}, x -> transform(array(x.a), a -> transform(array(x.b), b -> {piece})[0])[0])")
    return found.withColumn(text_col, F.when(F.col(runs).isNotNull(), F.concat_ws(mask, pieces)).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
