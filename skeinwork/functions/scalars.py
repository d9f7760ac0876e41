"""Scalar functions in their conventional meaning, as column expressions, and their SQL names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000


def trunc(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x))).cast("double")


def strpos(text: Column, part: Column) -> Column:
    return F.expr("1").cast("bigint") * F.call_function("instr", text, part)


def divide(a: Column, b: Column, integers: bool) -> Column:
    """``/``: integers truncate towards zero and stay 64-bit; a zero divisor is an error."""
    return F.call_function("div", a, b) if integers else a / b


# ------------------------------------------------------------------ intervals: struct<months, micros>


def interval(months: int | Column = 0, micros: int | Column = 0) -> Column:
    month, micro = (x if isinstance(x, Column) else F.lit(x) for x in (months, micros))
    return F.struct(month.cast("bigint").alias("months"), micro.cast("bigint").alias("micros"))


def interval_add(a: Column, b: Column, sign: int = 1) -> Column:
    return F.struct((a["months"] + sign * b["months"]).alias("months"), (a["micros"] + sign * b["micros"]).alias("micros"))


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def shift(t: Column, by: Column, sign: int = 1) -> Column:
    """DATE or TIMESTAMP plus or minus an interval: months first, clamped to the month's end, then microseconds."""
    stamp = t.cast("timestamp_ntz")
    moved = F.timestamp_add("MONTH", (sign * by["months"]).cast("int"), stamp)
    days = F.floor(by["micros"] / MICROS_A_DAY)
    rest = by["micros"] - days * MICROS_A_DAY
    moved = F.timestamp_add("DAY", (sign * days).cast("int"), moved)
    seconds = F.floor(rest / 1_000_000)
    moved = F.timestamp_add("SECOND", (sign * seconds).cast("int"), moved)
    return F.timestamp_add("MICROSECOND", (sign * (rest - seconds * 1_000_000)).cast("int"), moved)


def between(a: Column, b: Column) -> Column:
    """a - b of two dates or timestamps: an interval of microseconds."""
    return interval(0, F.timestamp_diff("MICROSECOND", b.cast("timestamp_ntz"), a.cast("timestamp_ntz")))


def shift_time(micros: Column, by: Column, sign: int = 1) -> Column:
    """TIME (microseconds since midnight) plus or minus an interval, round the clock; months are an error."""
    moved = F.pmod(micros + sign * by["micros"], F.lit(MICROS_A_DAY))
    return F.when(by["months"] == 0, moved).otherwise(F.raise_error(F.lit("TIME with an interval of months")).cast("bigint"))


def age(a: Column, b: Column) -> Column:
    """a - b as whole months and the rest in microseconds."""
    months = F.floor(F.months_between(a.cast("timestamp"), b.cast("timestamp"))).cast("int")
    moved = F.timestamp_add("MONTH", months, b.cast("timestamp_ntz"))
    return interval(months, F.timestamp_diff("MICROSECOND", moved, a.cast("timestamp_ntz")))


# ------------------------------------------------------------------ points and JSON


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))


def json_step(key: str | int) -> str:
    """A key or a place as a step of a path; keys are quoted, so that dots and blanks in them mean themselves."""
    if isinstance(key, int):
        return f"[{key}]"
    return f'["{key}"]' if '"' not in key else f"['{key}']"


def json_get(json: Column, *keys: str | int) -> Column:
    """``->``: the value at the keys as JSON text; NULL if missing or if a step's kind doesn't fit."""
    path = "$" + "".join(map(json_step, keys))
    return F.to_json(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def json_text(json: Column, *keys: str | int) -> Column:
    """``->>``: the same with strings unquoted; JSON null gives the text null."""
    path = "$" + "".join(map(json_step, keys))
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.is_variant_null(value), F.lit("null")).when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def to_interval(text: Column) -> Column:
    """'2 months 3 days 04:05:06' or 'P1M'-free text of number and unit pairs as an interval."""
    total_months = sum((F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(-?\d+)\s*{unit}", 1), F.lit("")), F.lit("S999999999")), F.lit(0)).cast("bigint") * n for unit, n in (("year", 12), ("mon", 1))), F.lit(0))
    units = (("week", 7 * MICROS_A_DAY), ("day", MICROS_A_DAY), ("hour", 3_600_000_000), ("min", 60_000_000), ("sec", 1_000_000))
    micros = sum((F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(-?\d+)\s*{unit}", 1), F.lit("")), F.lit("S999999999")), F.lit(0)).cast("bigint") * n for unit, n in units), F.lit(0))
    return F.when(text.isNotNull(), interval(total_months, micros))


def to_point(text: Column) -> Column:
    """'(x,y)' as a point."""
    pair = F.split(F.regexp_replace(text, r"[()\s]", ""), ",")
    return F.when(text.isNotNull(), point(F.get(pair, F.lit(0)).cast("double"), F.get(pair, F.lit(1)).cast("double")))


# ------------------------------------------------------------------ calls of the dialect, as SQL


_DATE_PATTERNS = (
    ("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("month", "MMMM"), ("MON", "MMM"), ("Mon", "MMM"), ("mon", "MMM"), ("MM", "MM"), ("DAY", "EEEE"), ("Day", "EEEE"), ("day", "EEEE"),
    ("DY", "EEE"), ("Dy", "EEE"), ("dy", "EEE"), ("DDD", "DDD"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("am", "a"), ("pm", "a"), ("Q", "q"),
)


def date_pattern(pattern: str) -> str:
    """A pattern of TO_CHAR and its kin as Spark's date pattern; text in double quotes stays text."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == '"':
            end = pattern.find('"', i + 1)
            end = len(pattern) if end < 0 else end
            out, i = out + "'" + pattern[i + 1 : end] + "'", end + 1
        elif pattern.startswith("FM", i):
            i += 2
        elif (known := next(((a, b) for a, b in _DATE_PATTERNS if pattern.startswith(a, i) or pattern.startswith(a.lower(), i)), None)) is not None:
            out, i = out + known[1], i + len(known[0])
        else:
            out, i = out + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return out


def _literal(text: str) -> str | None:
    """What a string literal of SQL says; None for anything else."""
    return text[1:-1].replace("''", "'") if len(text) > 1 and text[0] == text[-1] == "'" else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is_number_pattern(pattern: str) -> bool:
    return all(c in "90.,DGSLMIPRF$ " for c in pattern) and any(c in "90" for c in pattern)


def _to_char(value: str, pattern: str) -> str | None:
    plain = _literal(pattern)
    if plain is None:
        return None
    if not _is_number_pattern(plain):
        return f"date_format({value}, {_quoted(date_pattern(plain))})"
    filled = plain.replace("FM", "").replace("D", ".").replace("G", ",")
    decimals = sum(c in "90" for c in filled.partition(".")[2])
    number = f"concat(if({value} < 0, '-', ''), trim(to_char(abs(CAST(round({value}, {decimals}) AS DECIMAL(38, {decimals}))), {_quoted(filled)})))"
    return number if "FM" in plain else f"lpad({number}, {len(filled) + 1}, ' ')"


def _to_number(text: str, pattern: str) -> str | None:
    plain = _literal(pattern)
    return None if plain is None else f"CAST(to_number({text}, {_quoted(plain.replace('FM', ''))}) AS DOUBLE)"


def _by_pattern(function: str):
    def rewrite(text: str, pattern: str | None = None) -> str | None:
        if pattern is None:
            return f"CAST(to_timestamp({text}) AS TIMESTAMP_NTZ)" if function == "to_timestamp_ntz" else None
        plain = _literal(pattern)
        return None if plain is None else f"{function}({text}, {_quoted(date_pattern(plain))})"

    return rewrite


def _json_of(value: str) -> str:
    """Any value as JSON text, NULL as null."""
    return f"regexp_replace(to_json(array({value}), map('ignoreNullFields', 'false')), '^\\\\[|\\\\]$', '')"


def _json_extract(json: str, *path: str) -> str:
    """JSON_EXTRACT(json, path): a path from $, or keys and places one after the other."""
    steps = [_literal(p) if _literal(p) is not None else int(p) for p in path]
    whole = steps[0] if len(steps) == 1 and isinstance(steps[0], str) and steps[0].startswith("$") else "$" + "".join(map(json_step, steps))
    return f"json_get({json}, {_quoted(whole)})"


def _json_object(*parts: str) -> str:
    if len(parts) % 2:
        raise ValueError("JSON_OBJECT needs keys and values in pairs")
    pairs = [f"concat(to_json(array(CAST({k} AS STRING))), ':', {_json_of(v)})" for k, v in zip(parts[::2], parts[1::2], strict=True)]
    pairs = [p.replace("concat(to_json(array(", "concat(regexp_replace(to_json(array(", 1).replace(" AS STRING))), ':'", " AS STRING))), '^\\\\[|\\\\]$', ''), ':'", 1) for p in pairs]
    return f"concat('{{', concat_ws(',', {', '.join(pairs)}), '}}')" if pairs else "'{}'"


def _trunc(x: str, digits: str | None = None) -> str | None:
    if digits is None:
        return f"trunc_number({x})"
    return None if digits.startswith("'") else f"trunc_number(({x}) * power(10, {digits})) / power(10, {digits})"


#: Calls that become other SQL, by name: a function of the arguments' SQL; None leaves the call as it is.
REWRITES: dict[str, Callable[..., str | None]] = {
    "TRUNC": _trunc,
    "LOG": lambda x, y=None: f"log10({x})" if y is None else None,
    "AGE": lambda a, b=None: f"age_between({a}, {b})" if b is not None else f"age_between(CAST(current_date() AS TIMESTAMP_NTZ), {a})",
    "JSON_EXTRACT": _json_extract,
    "JSON_ARRAY": lambda *x: f"concat('[', concat_ws(',', {', '.join(map(_json_of, x))}), ']')" if x else "'[]'",
    "JSON_OBJECT": _json_object,
    "TO_CHAR": _to_char,
    "TO_NUMBER": _to_number,
    "TO_DATE": _by_pattern("to_date"),
    "TO_TIMESTAMP": _by_pattern("to_timestamp_ntz"),
}


def _unit(unit: str, factor: int) -> str:
    return f"coalesce(try_cast(regexp_extract(lower(t), '(-?[0-9]+([.][0-9]+)?) *{unit}', 1) AS DOUBLE), 0) * {factor}"


_CLOCK = "(-?)([0-9]+):([0-9]+)(:([0-9]+([.][0-9]+)?))?"
_CLOCK_MICROS = (
    f"if(regexp_extract(t, '{_CLOCK}', 1) = '-', -1, 1) * (coalesce(try_cast(regexp_extract(t, '{_CLOCK}', 2) AS DOUBLE), 0) * 3600000000 "
    f"+ coalesce(try_cast(regexp_extract(t, '{_CLOCK}', 3) AS DOUBLE), 0) * 60000000 + coalesce(try_cast(regexp_extract(t, '{_CLOCK}', 5) AS DOUBLE), 0) * 1000000)"
)
_TO_INTERVAL = (
    "if(t IS NULL, NULL, named_struct('months', CAST(" + " + ".join([_unit("y", 12), _unit("mon", 1)]) + " AS BIGINT), 'micros', CAST("
    + " + ".join([_unit("w", 7 * MICROS_A_DAY), _unit("d", MICROS_A_DAY), _unit("h", 3_600_000_000), _unit("min", 60_000_000), _unit("s", 1_000_000), _CLOCK_MICROS]) + " AS BIGINT)))"
)
_PAIR = "split(regexp_replace(t, '[() ]', ''), ',')"

#: Names that Spark lacks or means otherwise, as SQL functions of a session.
SQL_FUNCTIONS = {
    "gen_random_uuid": ("", "STRING", "uuid()"),
    "gen_uuid": ("", "STRING", "uuid()"),
    "uuid_generate_v4": ("", "STRING", "uuid()"),
    "strpos": ("t STRING, p STRING", "BIGINT", "CAST(instr(t, p) AS BIGINT)"),
    "trunc_number": ("x DOUBLE", "DOUBLE", "signum(x) * floor(abs(x))"),
    "age_between": (
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "STRUCT<months: BIGINT, micros: BIGINT>",
        "named_struct('months', CAST(floor(months_between(a, b, false)) AS BIGINT), 'micros', timestampdiff(MICROSECOND, timestampadd(MONTH, CAST(floor(months_between(a, b, false)) AS INT), b), a))",
    ),
    "to_interval": ("t STRING", "STRUCT<months: BIGINT, micros: BIGINT>", _TO_INTERVAL),
    "to_point": ("t STRING", "STRUCT<x: DOUBLE, y: DOUBLE>", f"if(t IS NULL, NULL, named_struct('x', CAST({_PAIR}[0] AS DOUBLE), 'y', CAST({_PAIR}[1] AS DOUBLE)))"),
    "pg_current_wal_lsn": ("", "BIGINT", "CAST(NULL AS BIGINT)"),
    "pg_is_in_recovery": ("", "BOOLEAN", "false"),
    "pg_last_wal_replay_lsn": ("", "BIGINT", "CAST(NULL AS BIGINT)"),
    "point_distance": ("a STRUCT<x: DOUBLE, y: DOUBLE>, b STRUCT<x: DOUBLE, y: DOUBLE>", "DOUBLE", "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"),
    "path_length": ("p STRUCT<nodes: ARRAY<BIGINT>, edges: ARRAY<BIGINT>>", "BIGINT", "CAST(size(p.nodes) - 1 AS BIGINT)"),
    "json_get": ("j STRING, p STRING", "STRING", "to_json(try_variant_get(try_parse_json(j), p, 'variant'))"),
    "json_text": (
        "j STRING, p STRING", "STRING",
        "CASE WHEN is_variant_null(try_variant_get(try_parse_json(j), p, 'variant')) THEN 'null' WHEN schema_of_variant(try_variant_get(try_parse_json(j), p, 'variant')) = 'STRING' THEN try_variant_get(try_parse_json(j), p, 'string') ELSE to_json(try_variant_get(try_parse_json(j), p, 'variant')) END",
    ),
}


def register(spark: SparkSession) -> None:
    """Make ``SQL_FUNCTIONS`` known to the session, as SQL bodies that the optimizer inlines."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
