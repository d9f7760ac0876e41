"""The SQL front end: graph, vector and text clauses become DataFrames, all else is Spark SQL.

TRAVERSE, MATCH patterns, SHORTEST PATH and algorithm calls are planned into temporary views that stand
in for them in the surrounding SELECT. NEAREST and MATCH .. TO predicates replace their table by the
ranked rows and themselves by TRUE. What is left gets this dialect's NULL order, integer division,
JSON and point operators, and goes to Catalyst.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TYPES, Catalog, CatalogError, ColumnMeta, Constraints, Database
from ..functions import scalars
from ..functions.scalars import register
from ..graph import match as patterns
from ..graph import traverse as traversal
from ..graph.registry import REGISTRY
from ..operators import changes
from ..text import bm25
from ..vector import nearest, provider
from .tokens import Token, closing, join, split, tokenize

_COUNTER = itertools.count()
_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_END_OF_ORDER = ("LIMIT", "OFFSET", "ROWS", "RANGE", "UNION", "INTERSECT", "EXCEPT", ")")
_CLAUSES = ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ON", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "AS", ")", ",", ";", "SET", "RETURNING", "USING", "WITHIN", "TO", "AND", "OR", "MATCH", "RETURN", "WEIGHT")


def _word(text: str) -> Token:
    return Token(text, "word")


def _value(tokens: Sequence[Token]) -> object:
    """A literal: number, string, boolean or NULL."""
    sign = -1 if tokens[0] == "-" else 1
    t = tokens[-1]
    if t.kind == "number":
        return sign * (float(t) if "." in t or "e" in t.lower() else int(t))
    if t.kind == "string":
        return t[1:-1].replace("''", "'")
    if t.is_("TRUE", "FALSE"):
        return t.is_("TRUE")
    if t.is_("NULL"):
        return None
    raise ValueError(f"a literal was expected, not {join(list(tokens))!r}")


def _operand_start(out: list[Token]) -> int:
    """Where the operand begins that the tokens end with: a name, a literal, a call or a bracket."""
    k = len(out) - 1
    if out[k] in (")", "]"):
        depth = 0
        while True:
            depth += (out[k] in (")", "]")) - (out[k] in ("(", "["))
            if not depth:
                break
            k -= 1
        if k and out[k - 1].kind == "word" and not out[k - 1].is_("IN", "AND", "OR", "NOT", "WHERE", "SELECT", "BY", "ON", "THEN", "ELSE", "WHEN", "DIV", "DISTINCT", "BETWEEN", "LIKE"):
            k -= 1
    while k >= 2 and out[k - 1] == ".":
        k -= 2
    return k


def _operand_end(tokens: list[Token], i: int) -> int:
    """Where the operand ends that begins at ``i``."""
    while i < len(tokens) and tokens[i] in ("-", "+"):
        i += 1
    if tokens[i] == "(":
        return closing(tokens, i) + 1
    i += 1
    while i + 1 < len(tokens) and tokens[i] == ".":
        i += 2
    return closing(tokens, i) + 1 if i < len(tokens) and tokens[i] == "(" else i


def _block(tokens: list[Token], i: int) -> list[Token]:
    """The innermost SELECT around the token at ``i``; all tokens if there is none in brackets."""
    depth, start = 0, i
    while start > 0:
        start -= 1
        depth += (tokens[start] == ")") - (tokens[start] == "(")
        if depth < 0:
            depth = 0
            if tokens[start + 1].is_("SELECT", "WITH"):
                return tokens[start + 1 : closing(tokens, start)]
    return tokens


class Engine:
    """A session of the dialect over one catalog."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.catalog = spark, Catalog(spark)
        self._snapshot: dict[str, Database] | None = None
        register(spark)

    # ------------------------------------------------------------ statements

    def sql(self, text: str, *args: object) -> DataFrame:
        """Run one statement; ``args`` stand for $1, $2 and so on."""
        tokens = tokenize(text)
        while tokens and tokens[-1] == ";":
            tokens.pop()
        tokens = [self._literal(args[int(t[1:]) - 1]) if t.kind == "param" else t for t in tokens]
        if not tokens:
            raise ValueError("empty statement")
        name = tokens[0].upper()
        handler = getattr(self, f"_do_{name.lower()}", None)
        return handler(tokens) if handler else self.spark.sql(join(self._rewrite(tokens)))

    @staticmethod
    def _literal(value: object) -> Token:
        if value is None:
            return _word("NULL")
        if isinstance(value, bool):
            return _word(str(value).upper())
        return Token(str(value), "number") if isinstance(value, (int, float)) else Token("'" + str(value).replace("'", "''") + "'", "string")

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    def _done(self) -> DataFrame:
        return self.spark.createDataFrame([], "status string")

    def _view(self, df: DataFrame) -> Token:
        name = f"__skein_{next(_COUNTER)}"
        df.createOrReplaceTempView(name)
        return _word(name)

    # ------------------------------------------------------------ SELECT

    def _rewrite(self, tokens: list[Token]) -> list[Token]:
        tokens = self._sources(self._qualified_tables(tokens))
        tokens = self._predicates(tokens)
        return self._null_order(self._operators(tokens))

    def _qualified_tables(self, tokens: list[Token]) -> list[Token]:
        """database.table in FROM becomes a view of that table."""
        out, i = [], 0
        while i < len(tokens):
            if i + 2 < len(tokens) and out and out[-1].is_("FROM", "JOIN", ",") and tokens[i + 1] == "." and tokens[i] in self.catalog.databases and tokens[i + 2] in self.catalog.databases[tokens[i]].tables:
                out.append(self._view(self.catalog.databases[tokens[i]].tables[tokens[i + 2]].data))
                if i + 3 >= len(tokens) or not (tokens[i + 3].is_("AS") or tokens[i + 3].kind == "word" and not tokens[i + 3].is_(*_CLAUSES)):
                    out.append(tokens[i + 2])
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _sources(self, tokens: list[Token]) -> list[Token]:
        """Replace graph sources by views."""
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            t, before = tokens[i], out[-1] if out else None
            source = before is not None and before.is_("FROM", "JOIN", ",")
            nested = before is not None and before == "("
            if t.is_("TRAVERSE") and (source or nested) and not (before.is_("WITHIN")):
                df, i, link = self._traverse(tokens, i, rows=source)
                view = self._view(df)
                out += [view] if source else [_word("SELECT"), _word("*"), _word("FROM"), view] if link is None else [
                    _word("SELECT"), _word("node"), Token(",", "sign"), _word("depth"), _word("FROM"), view, _word("WHERE"), _word("origin"), Token("=", "sign"), *link]
                if source and (i >= len(tokens) or not (tokens[i].is_("AS") or tokens[i].kind == "word" and not tokens[i].is_(*_CLAUSES))):
                    out.append(_word("__traverse"))
            elif t.is_("MATCH") and (source or nested) and i + 1 < len(tokens) and not self._is_text_match(tokens, i):
                end = i + 1
                depth = 0
                while end < len(tokens):
                    depth += (tokens[end] in ("(", "[", "{")) - (tokens[end] in (")", "]", "}"))
                    if depth < 0 or source and depth == 0 and (tokens[end].is_(*_CLAUSES) and tokens[end] not in (")", ",") or tokens[end].kind == "word" and tokens[end - 1] in (")", "}", "+", "*")):
                        break
                    end += 1
                if source:
                    df = self._match([*tokens[i:end], _word("RETURN"), _word("*")])
                    out.append(self._view(df))
                else:
                    df, outer = self._match_correlated(tokens[i:end])
                    out += [_word("SELECT"), _word("*"), _word("FROM"), self._view(df)] if outer is None else outer(self._view(df))
                i = end
            elif t.is_("SHORTEST") and (source or nested):
                df, i = self._shortest(tokens, i)
                out += [self._view(df)] if source else [_word("SELECT"), _word("*"), _word("FROM"), self._view(df)]
            elif source and t.kind == "word" and t.lower() in REGISTRY.functions and i + 2 < len(tokens) and tokens[i + 1] == "(" and tokens[i + 2].kind == "string":
                end = closing(tokens, i + 1)
                first, *rest = split(tokens[i + 2 : end])
                parameters = {p[0].lower(): _value(p[2:]) for p in rest}
                out.append(self._view(REGISTRY.call(t, self.catalog.edge(_value(first)).data, **parameters)))
                i = end + 1
            elif source and t.lower().startswith("pg_") and t.lower() in ("pg_database", "pg_namespace", "pg_type", "pg_class", "pg_attribute", "pg_index", "pg_catalog"):
                if t.is_("PG_CATALOG"):
                    i += 2
                out.append(self._view(self.catalog.virtual(tokens[i].lower())))
                i += 1
            else:
                out.append(t)
                i += 1
        return out

    @staticmethod
    def _is_text_match(tokens: list[Token], i: int) -> bool:
        if tokens[i + 1] != "(":
            return False
        end = closing(tokens, i + 1)
        return end + 1 < len(tokens) and tokens[end + 1].is_("TO")

    def _predicates(self, tokens: list[Token]) -> list[Token]:
        """Replace NEAREST and MATCH .. TO by ranked tables."""
        found = [i for i, t in enumerate(tokens) if t.is_("NEAREST") and i + 1 < len(tokens) and tokens[i + 1] == "(" or t.is_("MATCH") and self._is_text_match(tokens, i)]
        if not found:
            return tokens
        if len(found) > 1:
            raise ValueError("one NEAREST or MATCH predicate in a query")
        i = found[0]
        end = closing(tokens, i + 1)
        arguments = split(tokens[i + 2 : end])
        column = arguments[0][-1]
        owner = arguments[0][0] if len(arguments[0]) > 1 else None
        at, name, alias = self._owner(tokens, column, owner)
        meta = self.catalog.table(name)
        pk = meta.pk[0] if meta.pk else None
        end += 1
        if tokens[i].is_("MATCH"):
            text, end = _value([tokens[end + 1]]), end + 2
            has = [x for x in self.catalog.db.indexes.values() if x.table == name and x.kind == "BM25" and x.columns == [str(column)]]
            if not has:
                raise CatalogError(f"MATCH needs a BM25 index on {name}.{column}")
            if has[0].cached is None or has[0].cached[0] is not meta.data:
                has[0].cached = (meta.data, bm25.index(meta.data, pk, column, keep=True))
            ranked = bm25.match(meta.data, pk, column, text, indexed=has[0].cached[1])
        else:
            k, metric, scope, query = _value(arguments[1]), "COSINE", None, None
            while end < len(tokens) and tokens[end].is_("TO", "WITHIN", "USING"):
                if tokens[end].is_("USING"):
                    metric, end = tokens[end + 1].upper(), end + 2
                elif tokens[end].is_("WITHIN"):
                    reached, stop, _ = self._traverse(tokens, end + 1, rows=False)
                    edge = self.catalog.edge(tokens[end + 2])
                    if edge.target != name:
                        raise CatalogError(f"the traversal reaches {edge.target}, not {name}")
                    scope = reached.select("node")
                    if edge.source == edge.target:
                        start = _value(tokens[tokens.index("(", end) + 1 : closing(tokens, tokens.index("(", end))])
                        scope = scope.union(self.spark.range(1).select(F.lit(start).cast(scope.schema[0].dataType).alias("node")))
                    end = stop
                elif tokens[end + 1] == "[":
                    close = closing(tokens, end + 1)
                    query, end = [float(_value(p)) for p in split(tokens[end + 2 : close])], close + 1
                else:
                    text, end = _value([tokens[end + 1]]), end + 2
                    dim, _, kind = meta.column(column).embedding
                    query = provider.PROVIDERS[kind]([text], dim)[0]
            ranked = nearest.nearest(meta.data, column, k, query, metric, pk, scope=scope)
        tokens = [*tokens[:i], _word("TRUE"), *tokens[end:]]
        view = [self._view(ranked)] + ([] if alias else [_word(name)])
        return [*tokens[:at], *view, *tokens[at + 1 :]]

    def _owner(self, tokens: list[Token], column: str, owner: str | None) -> tuple[int, str, str | None]:
        """Where the table of a ranked column stands in FROM, its name and its alias."""
        options = []
        for i, t in enumerate(tokens):
            if t in self.catalog.db.tables and i and tokens[i - 1].is_("FROM", "JOIN", ","):
                nxt = tokens[i + 2 if i + 1 < len(tokens) and tokens[i + 1].is_("AS") else i + 1] if i + 1 < len(tokens) else None
                alias = str(nxt) if nxt is not None and nxt.kind == "word" and not nxt.is_(*_CLAUSES) else None
                if (owner in (None, alias or t)) and any(c.name == column for c in self.catalog.table(t).columns):
                    options.append((i, str(t), alias))
        if len(options) != 1:
            raise CatalogError(f"{column!r} belongs to {len(options)} tables of FROM")
        at = options[0][0]
        if tokens[at - 1].is_("JOIN") and at >= 2 and tokens[at - 2].is_("LEFT", "FULL", "OUTER"):
            raise ValueError("a ranked table can't be on the nullable side of a join")
        return options[0]

    def _types(self, tokens: list[Token]) -> dict[str, str]:
        """Types of the columns of the catalog's tables that the query names; None where they differ."""
        out: dict[str, str] = {}
        for t in set(tokens):
            if t in self.catalog.db.tables:
                for n, kind in self.catalog.table(t).data.dtypes:
                    out[n] = kind if out.get(n, kind) == kind else "?"
        return out

    def _functions(self, tokens: list[Token]) -> list[Token]:
        """Functions and casts that Spark lacks or means otherwise, as ones that it has."""
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            call = t.kind == "word" and i + 1 < len(tokens) and tokens[i + 1] == "(" and (not out or out[-1] != ".")
            if call and t.upper() in scalars.REWRITES:
                end = closing(tokens, i + 1)
                arguments = [join(self._functions(p)) for p in split(tokens[i + 2 : end])]
                new = scalars.REWRITES[t.upper()](*arguments)
                out += [t, *self._functions(tokens[i + 1 : end + 1])] if new is None else tokenize(new)
                i = end + 1
            elif call and t.is_("CAST", "TRY_CAST"):
                end = closing(tokens, i + 1)
                at = max((k for k in range(i + 2, end) if tokens[k].is_("AS")), default=end)
                out += self._cast(self._functions(tokens[i + 2 : at]), tokens[at + 1 : end], t)
                i = end + 1
            elif t == "::":
                stop = closing(tokens, i + 2) + 1 if i + 2 < len(tokens) and tokens[i + 2] == "(" else i + 2
                k = _operand_start(out)
                out[k:] = self._cast(out[k:], tokens[i + 1 : stop], _word("CAST"))
                i = stop
            else:
                out.append(t)
                i += 1
        return out

    @staticmethod
    def _cast(value: list[Token], kind: list[Token], name: Token) -> list[Token]:
        """A cast to a type of the dialect: texts become intervals and points by functions."""
        base = kind[0].upper() if kind else ""
        if base in ("INTERVAL", "POINT") and len(kind) == 1:
            return [_word(f"to_{base.lower()}"), Token("(", "sign"), *value, Token(")", "sign")]
        if base in TYPES and base not in ("DECIMAL", "NUMERIC", "VARCHAR", "CHAR"):
            kind = [_word(TYPES[base]), *kind[1:]]
        elif base in ("VARCHAR", "CHAR"):
            kind = [_word("string")]
        return [name, Token("(", "sign"), *value, _word("AS"), *kind, Token(")", "sign")]

    def _is_integer(self, operand: list[Token], block: list[Token], scope: str | None) -> bool:
        """Whether an operand is of an integer type, as Spark finds it where it stands."""
        if len(operand) == 1 and operand[0].kind == "number":
            return operand[0].isdigit()
        sources = [scope] if scope else []
        start = next((k for k, t in enumerate(block) if t.is_("FROM") and not self._inside(block, k)), None)
        if start is not None:
            stop = next((k for k in range(start + 1, len(block)) if block[k].is_("WHERE", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "GROUP") and not self._inside(block, k)), len(block))
            group = next((k for k in range(stop, len(block)) if block[k].is_("GROUP") and not self._inside(block, k)), None)
            end = next((k for k in range(group + 1, len(block)) if block[k].is_("HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT") and not self._inside(block, k)), len(block)) if group is not None else 0
            sources.append(join(block[start:stop]) + (" " + join(block[group:end]) if group is not None else ""))
        first = next((k for k, t in enumerate(block) if t.is_("SELECT") and not self._inside(block, k)), 0)
        chain = join(block[:first]) + " " if block and block[0].is_("WITH") else ""
        for source in [*sources, ""]:
            try:
                return self.spark.sql(f"{chain}SELECT {join(operand)} AS operand {source}").dtypes[0][1] in _INTEGERS
            except (PySparkException, ValueError):
                continue
        types = self._types(block)  # an operand of an outer query: by its column's name
        return len(operand) == 1 and types.get(operand[0]) in _INTEGERS

    def _operators(self, tokens: list[Token], scope: str | None = None) -> list[Token]:
        """Functions and casts of the dialect, -> and ->> on JSON, <-> on points, / of integers.

        ``scope``: a FROM clause in which the columns of a lone expression are known.
        """
        tokens = self._functions(tokens)
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if t in ("->", "->>") and out:
                path, last = "$", t
                while i + 1 < len(tokens) and tokens[i] in ("->", "->>"):
                    last, key = tokens[i], _value([tokens[i + 1]])
                    path += scalars.json_step(key)
                    i += 2
                k = _operand_start(out)
                quoted = "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"
                out[k:] = [_word("json_text" if last == "->>" else "json_get"), Token("(", "sign"), *out[k:], Token(",", "sign"), Token(quoted, "string"), Token(")", "sign")]
                continue
            if t == "<->":
                k, stop = _operand_start(out), _operand_end(tokens, i + 1)
                out[k:] = [_word("point_distance"), Token("(", "sign"), *out[k:], Token(",", "sign"), *tokens[i + 1 : stop], Token(")", "sign")]
                i = stop
                continue
            if t == "/" and out:
                k = _operand_start(out)
                while k and (out[k - 1] in ("*", "/", "%") or out[k - 1].is_("DIV")) and k > 1:
                    k = _operand_start(out[: k - 1])
                block = _block(tokens, i)
                if self._is_integer(out[k:], block, scope) and self._is_integer(tokens[i + 1 : _operand_end(tokens, i + 1)], block, scope):
                    t = _word("DIV")
            out.append(t)
            i += 1
        return out

    @staticmethod
    def _null_order(tokens: list[Token]) -> list[Token]:
        """NULLs last ascending and first descending, wherever the query doesn't say."""
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            out.append(tokens[i])
            if tokens[i].is_("BY") and tokens[i - 1].is_("ORDER"):
                depth, item, items, k = 0, [], [], i + 1
                while k < len(tokens) and not (depth == 0 and (tokens[k].is_(*_END_OF_ORDER))):
                    depth += (tokens[k] in ("(", "[")) - (tokens[k] in (")", "]"))
                    if depth == 0 and tokens[k] == ",":
                        items.append(item)
                        item = []
                    else:
                        item.append(tokens[k])
                    k += 1
                items.append(item)
                for n, item in enumerate(items):
                    item = Engine._null_order(item)
                    if not any(x.is_("NULLS") for x in item):
                        item = [*item, _word("NULLS"), _word("FIRST" if item and item[-1].is_("DESC") else "LAST")]
                    out += ([Token(",", "sign")] if n else []) + item
                i = k
                continue
            i += 1
        return out

    def _do_explain(self, tokens: list[Token]) -> DataFrame:
        """The physical plan as rows of text, or one row of JSON; ANALYZE runs the query first."""
        rest, analyze, as_json = tokens[1:], False, False
        while rest and rest[0].is_("ANALYZE", "FORMAT", "TEXT", "JSON", "(", ")", ",", "VERBOSE"):
            if rest[0] == "(" and not rest[1].is_("ANALYZE", "FORMAT", "VERBOSE"):
                break
            analyze |= rest[0].is_("ANALYZE")
            as_json |= rest[0].is_("JSON")
            rest = rest[1:]
        df = self.sql(join(rest))
        rows = df.count() if analyze else None
        execution = df._jdf.queryExecution()
        if as_json:
            plan = {"Plan": json.loads(execution.executedPlan().toJSON())}
            text = json.dumps(plan | ({"Actual Rows": rows} if analyze else {}))
            return self.spark.createDataFrame([(text,)], "plan string")
        plan = execution.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")

    # ------------------------------------------------------------ graph clauses

    def _traverse(self, tokens: list[Token], i: int, rows: bool) -> tuple[DataFrame, int, list[Token] | None]:
        """TRAVERSE e FROM t(key) [..]: (result, next token, outer key of a correlated one)."""
        edge = self.catalog.edge(tokens[i + 1])
        table = str(tokens[i + 3])
        if table not in (edge.source, edge.target):
            raise CatalogError(f"{edge.name} doesn't start at {table}")
        end = closing(tokens, i + 4)
        key, i = tokens[i + 5 : end], end + 1
        options: dict = {"direction": "OUT", "max_depth": traversal.MAX_DEPTH, "trace": False}
        where, mode, fetch = None, "NODES", False
        while i < len(tokens):
            if tokens[i].is_("DIRECTION"):
                options["direction"], i = tokens[i + 1].upper(), i + 2
            elif tokens[i].is_("MAX_DEPTH"):
                options["max_depth"], i = int(tokens[i + 1]), i + 2
            elif tokens[i].is_("MODE"):
                mode, i = tokens[i + 1].upper(), i + 2
            elif tokens[i].is_("FETCH"):
                fetch, i = True, i + 1
            elif tokens[i].is_("WITH") and tokens[i + 1].is_("TRACE"):
                options["trace"], i = True, i + 2
            elif tokens[i].is_("WHERE") and not rows:
                stop, depth = i + 1, 0
                while stop < len(tokens) and not (depth == 0 and tokens[stop].is_(")", "FETCH", "WITH", "TO", "USING")):
                    depth += (tokens[stop] == "(") - (tokens[stop] == ")")
                    stop += 1
                where, i = join(tokens[i + 1 : stop]), stop
            else:
                break
        hetero = edge.source != edge.target
        if len(key) >= 3 and key[1] == ".":
            starts = self.catalog.table(table).data.select(F.col(self.catalog.table(table).pk[0]).alias("origin"))
            depth = min(options["max_depth"], 1) if hetero else options["max_depth"]
            df = traversal.reach(edge.data, starts.select("origin", F.col("origin").alias("node")), options["direction"], depth)
            return df.where(where) if where else df, i, key
        start = _value(key)
        if mode == "EDGES":
            df = traversal.traverse_edges(edge.data, start, options["direction"], min(options["max_depth"], 1) if hetero else options["max_depth"])
        elif rows:
            target = self.catalog.table(edge.target if options["direction"] != "IN" else edge.source)
            df = traversal.traverse_rows(edge.data, start, target.data, target.pk[0], heterogeneous=hetero, **options)
        else:
            df = traversal.traverse(edge.data, start, heterogeneous=hetero, **options)
            path = [F.struct(F.col("path_nodes").alias("nodes"), F.col("path_edges").alias("edges")).alias("__path")] if options["trace"] else []
            df = df.select("node", "depth", *(["source"] if fetch or where and "source" in where else []), *path)
        return df.where(where) if where else df, i, None

    def _do_traverse(self, tokens: list[Token]) -> DataFrame:
        df, end, _ = self._traverse(tokens, 0, rows=False)
        if end != len(tokens):
            raise ValueError(f"unexpected {join(tokens[end:])!r}")
        return df

    def _shortest(self, tokens: list[Token], i: int) -> tuple[DataFrame, int]:
        """SHORTEST PATH FROM t(a) TO u(b) VIA e [DIRECTION d] [MAX_DEPTH n]."""
        first = closing(tokens, i + 4)
        source = _value(tokens[i + 5 : first])
        second = closing(tokens, first + 3)
        target = _value(tokens[first + 4 : second])
        edge, i = self.catalog.edge(tokens[second + 2]), second + 3
        options: dict = {}
        while i + 1 < len(tokens) and tokens[i].is_("DIRECTION", "MAX_DEPTH"):
            options[tokens[i].lower()] = tokens[i + 1].upper() if tokens[i].is_("DIRECTION") else int(tokens[i + 1])
            i += 2
        return traversal.shortest_path(edge.data, source, target, **options), i

    def _do_shortest(self, tokens: list[Token]) -> DataFrame:
        return self._shortest(tokens, 0)[0]

    def _do_match(self, tokens: list[Token]) -> DataFrame:
        return self._match(tokens)

    def _match_correlated(self, tokens: list[Token]):
        """A nested MATCH whose WHERE ties a variable to an outer column: the tie moves into the view's filter."""
        names = {tokens[k + 1] for k, t in enumerate(tokens[:-2]) if t in ("(", "[") and tokens[k + 2] == ":"}
        where = next((k for k, t in enumerate(tokens) if t.is_("WHERE") and not self._inside(tokens, k)), None)
        ret = next(k for k, t in enumerate(tokens) if t.is_("RETURN"))
        if where is None:
            return self._match(tokens), None
        keep, ties = [], []
        for part in split(tokens[where + 1 : ret], "AND"):
            outer = [k for k in range(len(part) - 2) if part[k].kind == "word" and part[k + 1] == "." and part[k] not in names]
            (ties if outer else keep).append(part)
        if not ties:
            return self._match(tokens), None
        items = tokens[ret + 1 :]
        extra: list[Token] = []
        filters: list[Token] = []
        for part in ties:
            k = next(k for k in range(len(part) - 2) if part[k] in names and part[k + 1] == ".")
            name = _word(f"__tie{len(extra)}")
            extra += [Token(",", "sign"), *part[k : k + 3], _word("AS"), name]
            filters += ([_word("AND")] if filters else []) + [*part[:k], name, *part[k + 3 :]]
        where_tokens: list[Token] = []
        for part in keep:
            where_tokens += ([_word("AND")] if where_tokens else [_word("WHERE")]) + part
        n = len(split(items))
        df = self._match([*tokens[:where], *where_tokens, _word("RETURN"), *items, *extra])
        shown = df.columns[:n]

        def outer_query(view: Token) -> list[Token]:
            columns: list[Token] = []
            for c in shown:
                columns += ([Token(",", "sign")] if columns else []) + [_word(f"`{c}`")]
            return [_word("SELECT"), *columns, _word("FROM"), view, _word("WHERE"), *filters]

        return df, outer_query

    @staticmethod
    def _inside(tokens: list[Token], k: int) -> bool:
        depth = 0
        for t in tokens[:k]:
            depth += (t in ("(", "[")) - (t in (")", "]"))
        return depth > 0

    def _match(self, tokens: list[Token]) -> DataFrame:
        """MATCH [p =] [selector] pattern [WEIGHT r.w] [WHERE ..] RETURN items."""
        i, selector, k, path = 1, None, 1, None
        if tokens[i + 1] == "=":
            path, i = str(tokens[i]), i + 2
        if tokens[i].is_("ANY", "ALL") and tokens[i + 1].is_("SHORTEST"):
            selector, i = tokens[i].upper(), i + 2
        elif tokens[i].is_("SHORTEST"):
            selector, k, i = "K", int(tokens[i + 1]), i + 2
        nodes: list[patterns.Node] = []
        edges: list[patterns.Edge] = []
        known: dict[str, patterns.Node] = {}
        while True:
            end = closing(tokens, i)
            inner = tokens[i + 1 : end]
            cut = next((j for j, t in enumerate(inner) if t.is_("WHERE")), len(inner))
            name = str(inner[0]) if inner and inner[0] != ":" else f"__n{len(nodes)}"
            label = next((str(inner[j + 1]) for j in range(cut - 1) if inner[j] == ":"), None)
            where = self._inline(inner[cut + 1 :], name) if cut < len(inner) else None
            if label is None and name not in known:
                raise ValueError(f"node {name!r} needs a table")
            if name in known:
                nodes.append(known[name])
            else:
                meta = self.catalog.table(label)
                nodes.append(patterns.Node(name, meta.data, meta.pk[0], where))
                known[name] = nodes[-1]
            i = end + 1
            if i >= len(tokens) or tokens[i] not in ("-", "<-"):
                break
            left = tokens[i] == "<-"
            end = closing(tokens, i + 1)
            inner = tokens[i + 2 : end]
            right = tokens[end + 1] == "->"
            i = end + 2
            cut = next((j for j, t in enumerate(inner) if t.is_("WHERE")), len(inner))
            name = str(inner[0]) if inner and inner[0] != ":" else f"__e{len(edges)}"
            label = next(str(inner[j + 1]) for j in range(cut - 1) if inner[j] == ":")
            where = self._inline(inner[cut + 1 :], name) if cut < len(inner) else None
            hops = None
            if tokens[i] == "{":
                end = closing(tokens, i)
                numbers = [int(p[0]) if p else None for p in split(tokens[i + 1 : end])]
                hops, i = (numbers[0], numbers[-1]), end + 1
            elif tokens[i] in ("+", "*"):
                hops, i = (1 if tokens[i] == "+" else 0, None), i + 1
            edges.append(patterns.Edge(name, self.catalog.edge(label).data, "IN" if left else "OUT" if right else "BOTH", hops, where))
        weight = None
        if i < len(tokens) and tokens[i].is_("WEIGHT"):
            weight, i = str(tokens[i + 3]), i + 4
        ret = next(j for j in range(i, len(tokens)) if tokens[j].is_("RETURN") and not self._inside(tokens, j))
        names = {n.name for n in nodes} | {e.name for e in edges} | ({path} if path else set())
        where = join(self._qualified(tokens[i + 1 : ret], names)) if tokens[i].is_("WHERE") else None
        if selector:
            a, b = nodes[0], nodes[-1]
            a_rows = a.table.where(a.where) if a.where else a.table
            found = patterns.shortest(edges[0], a_rows.select(F.col(a.pk).alias("start")), selector, k, weight)
            found = found.select("start", "node", F.struct("nodes", "edges", "total_weight").alias(f"{path or '__path'}.path"))
            bound = found.join(patterns.beside(a.rows()), F.col("start") == a.key).join(patterns.beside(b.rows()), F.col("node") == b.key).drop("start", "node")
            bound = bound.where(where) if where else bound
        else:
            bound = patterns.match(nodes, edges, where)
        items = tokens[ret + 1 :]
        if len(items) == 1 and items[0] == "*":
            plain = [c.split(".", 1)[1] for c in bound.columns]
            return bound.select(*[F.col(f"`{c}`").alias(p if plain.count(p) == 1 else c.replace(".", "_")) for c, p in zip(bound.columns, plain, strict=True)])
        out, scope = [], f"FROM {self._view(bound)}" if "/" in items else None
        for item in split(items):
            alias = None
            if len(item) > 2 and item[-2].is_("AS"):
                item, alias = item[:-2], str(item[-1])
            if alias is None:
                alias = str(item[-1]) if len(item) == 3 and item[1] == "." else str(item[0]).lower() if len(item) > 1 and item[1] == "(" else str(item[0])
            if len(item) == 4 and item[0].is_("PATH_LENGTH", "PATH_COST", "NODES", "EDGES", "RELATIONSHIPS"):
                function = {"PATH_LENGTH": patterns.path_length, "PATH_COST": patterns.path_cost, "NODES": patterns.path_nodes}.get(item[0].upper(), patterns.path_edges)
                out.append(function(F.col(f"`{item[2]}.path`")).alias(alias))
            elif len(item) == 1 and f"{item[0]}.path" in bound.columns:
                out.append(F.col(f"`{item[0]}.path`").alias(alias))
            else:
                out.append(F.expr(join(self._operators(self._qualified(item, names), scope))).alias(alias))
        return bound.select(*out)

    @staticmethod
    def _inline(tokens: list[Token], name: str) -> str:
        """An inline predicate over plain columns of its own variable."""
        out, i = [], 0
        while i < len(tokens):
            if tokens[i] == name and i + 1 < len(tokens) and tokens[i + 1] == ".":
                i += 2
            out.append(tokens[i])
            i += 1
        return join(out)

    @staticmethod
    def _qualified(tokens: list[Token], names: set[str]) -> list[Token]:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i] in names and i + 2 < len(tokens) and tokens[i + 1] == ".":
                out.append(_word(f"`{tokens[i]}.{tokens[i + 2].strip('`')}`"))
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    # ------------------------------------------------------------ changes of rows

    def _do_insert(self, tokens: list[Token]) -> DataFrame:
        table, i, columns = str(tokens[2]), 3, None
        if tokens[i] == "(":
            end = closing(tokens, i)
            columns, i = [str(p[0]).strip("`") for p in split(tokens[i + 1 : end])], end + 1
        rest, returning = self._returning(tokens[i:])
        if rest[0].is_("VALUES"):
            meta = self.catalog.table(table)
            names = columns or [c.name for c in meta.columns]
            rows = None
            parts = []
            for row in split(rest[1:]):
                values = split(row[1:-1])
                cells = []
                for name, v in zip(names, values, strict=False):
                    kind = meta.column(name).spark_type
                    text = join(self._operators(v))
                    cells.append(f"CAST(array({join(v[1:-1])}) AS {kind})" if v[0] == "[" else f"CAST({text} AS {kind})")
                if len(values) > len(names):
                    raise CatalogError("more values than columns")
                parts.append("SELECT " + ", ".join(cells))
            rows = self.spark.sql(" UNION ALL ".join(parts))
            columns = columns or names[: len(rows.columns)]
        else:
            rows = self.spark.sql(join(self._rewrite(rest)))
        fresh = changes.insert(self.catalog, table, rows, columns)
        return fresh.selectExpr(returning) if returning else self._count(fresh.count())

    @staticmethod
    def _returning(tokens: list[Token]) -> tuple[list[Token], list[str] | None]:
        at = next((i for i, t in enumerate(tokens) if t.is_("RETURNING")), None)
        return (tokens, None) if at is None else (tokens[:at], [join(p) for p in split(tokens[at + 1 :])])

    def _do_update(self, tokens: list[Token]) -> DataFrame:
        tokens, returning = self._returning(tokens)
        at = next((i for i, t in enumerate(tokens) if t.is_("WHERE") and not self._inside(tokens, i)), len(tokens))
        scope = f"FROM {tokens[1]}"
        pairs = {str(p[0]).strip("`"): join(self._operators(p[2:], scope)) for p in split(tokens[3:at])}
        changed = changes.update(self.catalog, str(tokens[1]), pairs, join(self._operators(tokens[at + 1 :], scope)) or None)
        return changed.selectExpr(returning) if returning else self._count(changed.count())

    def _do_delete(self, tokens: list[Token]) -> DataFrame:
        tokens, returning = self._returning(tokens)
        gone = changes.delete(self.catalog, str(tokens[2]), join(self._operators(tokens[4:], f"FROM {tokens[2]}")) or None)
        return gone.selectExpr(returning) if returning else self._count(gone.count())

    def _do_link(self, tokens: list[Token]) -> DataFrame:
        """LINK a(k) TO b(k) VIA e [(p = v, ..)]; LINK a TO b VIA e VALUES (s, t, p..), .."""
        via = next(i for i, t in enumerate(tokens) if t.is_("VIA"))
        edge = self.catalog.edge(tokens[via + 1])
        names = ["src", "dst", *[p.name for p in edge.properties]]
        rest = tokens[via + 2 :]
        if rest and rest[0].is_("VALUES"):
            rows = [[_value(v) for v in split(row[1:-1])] for row in split(rest[1:])]
            rows = [r + [None] * (len(names) - len(r)) for r in rows]
        else:
            first = closing(tokens, 2)
            second = closing(tokens, first + 3)
            given = {str(p[0]): _value(p[2:]) for p in split(rest[1:-1])} if rest else {}
            rows = [[_value(tokens[3:first]), _value(tokens[first + 4 : second]), *[given.get(n) for n in names[2:]]]]
        kinds = dict(edge.data.dtypes)
        parts = ["SELECT " + ", ".join(f"CAST({self._literal(v)} AS {kinds[n]}) AS `{n}`" for n, v in zip(names, row, strict=True)) for row in rows]
        return self._count(changes.link(self.catalog, edge.name, self.spark.sql(" UNION ALL ".join(parts))))

    def _do_unlink(self, tokens: list[Token]) -> DataFrame:
        first = closing(tokens, 2)
        second = closing(tokens, first + 3)
        via = next(i for i, t in enumerate(tokens) if t.is_("VIA"))
        rest = tokens[via + 2 :]
        where = join(rest[1:]) if rest else None
        return self._count(changes.unlink(self.catalog, str(tokens[via + 1]), _value(tokens[3:first]), _value(tokens[first + 4 : second]), where))

    # ------------------------------------------------------------ schema

    def _column(self, tokens: list[Token]) -> ColumnMeta:
        name, i, kind = str(tokens[0]).strip("`"), 2, str(tokens[1]).upper()
        if tokens[1].is_("DOUBLE") and len(tokens) > 2 and tokens[2].is_("PRECISION"):
            i = 3
        if tokens[1].is_("CHARACTER") and len(tokens) > 2 and tokens[2].is_("VARYING"):
            kind, i = "VARCHAR", 3
        out = ColumnMeta(name, kind)
        if i < len(tokens) and tokens[i] == "(":
            end = closing(tokens, i)
            inside = split(tokens[i + 1 : end])
            if kind == "EMBEDDING":
                sources = tuple(x.strip() for x in str(_value(inside[1]) if inside[1][0].kind == "string" else join(inside[1])).strip("()").split(",")) if len(inside) > 1 else ()
                out.embedding = (int(inside[0][0]), sources, str(_value(inside[2]) if inside[2][0].kind == "string" else inside[2][0]) if len(inside) > 2 else "builtin")
            else:
                out.type = f"{kind}({join(tokens[i + 1 : end])})"
            i = end + 1
        while i < len(tokens):
            t = tokens[i]
            if t.is_("PRIMARY"):
                out.primary, out.nullable, i = True, False, i + 2
            elif t.is_("NOT"):
                out.nullable, i = False, i + 2
            elif t.is_("NULL"):
                i += 1
            elif t.is_("UNIQUE"):
                out.unique, i = True, i + 1
            elif t.is_("AUTOINCREMENT", "AUTO_INCREMENT"):
                out.autoincrement, i = True, i + 1
            elif t.is_("DEFAULT"):
                stop = i + 1
                while stop < len(tokens) and not tokens[stop].is_("PRIMARY", "NOT", "UNIQUE", "CHECK", "REFERENCES"):
                    stop += 1
                out.default, i = join(tokens[i + 1 : stop]), stop
            elif t.is_("CHECK"):
                end = closing(tokens, i + 1)
                out.check, i = join(tokens[i + 2 : end]), end + 1
            elif t.is_("REFERENCES"):
                end = closing(tokens, i + 2)
                self.catalog.table(tokens[i + 1])
                out.references, i = (str(tokens[i + 1]), str(tokens[i + 3])), end + 1
                while i < len(tokens) and tokens[i].is_("ON", "DELETE", "UPDATE", "CASCADE", "RESTRICT", "SET"):
                    i += 1
            else:
                raise ValueError(f"unexpected {t!r} in the definition of {name!r}")
        out.spark_type  # noqa: B018  a wrong type name is an error now
        return out

    def _do_create(self, tokens: list[Token]) -> DataFrame:
        rest = tokens[1:]
        exists = any(a.is_("IF") and b.is_("NOT") for a, b in zip(rest, rest[1:], strict=False))
        rest = [t for i, t in enumerate(rest) if not (exists and i in range(1, 6) and t.is_("IF", "NOT", "EXISTS"))]
        if rest[0].is_("DATABASE"):
            name = str(rest[1])
            if name in self.catalog.databases and not exists:
                raise CatalogError(f"database {name!r} exists")
            self.catalog.databases.setdefault(name, Database(name))
        elif rest[0].is_("TABLE"):
            columns, keys, constraints = [], [], Constraints()
            for part in split(rest[3 : closing(rest, 2)]):
                if part[0].is_("CONSTRAINT"):
                    part = part[2:]
                if part[0].is_("PRIMARY"):
                    keys = [str(p[0]).strip("`") for p in split(part[3 : closing(part, 2)])]
                elif part[0].is_("UNIQUE"):
                    constraints.unique.append([str(p[0]).strip("`") for p in split(part[2 : closing(part, 1)])])
                elif part[0].is_("CHECK"):
                    constraints.checks.append(join(self._functions(part[2 : closing(part, 1)])))
                elif part[0].is_("FOREIGN"):
                    end = closing(part, 2)
                    other = closing(part, end + 3)
                    constraints.foreign.append(([str(p[0]).strip("`") for p in split(part[3:end])], str(part[end + 2]), [str(p[0]).strip("`") for p in split(part[end + 4 : other])]))
                    self.catalog.table(part[end + 2])
                else:
                    columns.append(self._column(part))
            for c in columns:
                if c.name in keys:
                    c.primary, c.nullable = True, False
            for name in [*keys, *(n for group in constraints.unique for n in group), *(n for group, _, _ in constraints.foreign for n in group)]:
                if name not in [c.name for c in columns]:
                    raise CatalogError(f"a constraint names the missing column {name!r}")
            changes.create_table(self.catalog, str(rest[1]), columns, exists, constraints)
        elif rest[0].is_("EDGE"):
            source = next(i for i, t in enumerate(rest) if t.is_("FROM"))
            target = next(i for i, t in enumerate(rest) if t.is_("TO"))
            props = [self._column(p) for p in split(rest[rest.index("(") + 1 : closing(rest, rest.index("("))])] if "(" in rest else []
            changes.create_edge_type(self.catalog, str(rest[2]), str(rest[source + 1]), str(rest[target + 1]), props)
        else:
            unique = rest[0].is_("UNIQUE")
            rest = rest[1:] if unique else rest
            at = rest.index("(")
            kind = next((rest[i + 1].upper() for i, t in enumerate(rest) if t.is_("USING")), "BTREE")
            on = next(i for i, t in enumerate(rest) if t.is_("ON"))
            changes.create_index(self.catalog, str(rest[1]), str(rest[on + 1]), [str(p[0]) for p in split(rest[at + 1 : closing(rest, at)])], kind, unique)
        return self._done()

    def _do_drop(self, tokens: list[Token]) -> DataFrame:
        exists = any(t.is_("EXISTS") for t in tokens)
        cascade = tokens[-1].is_("CASCADE")
        name = str(tokens[-2] if cascade else tokens[-1])
        if tokens[1].is_("TABLE"):
            changes.drop_table(self.catalog, name, exists, cascade)
        else:
            group = self.catalog.databases if tokens[1].is_("DATABASE") else self.catalog.db.edges if tokens[1].is_("EDGE") else self.catalog.db.indexes
            if name not in group and not exists:
                raise CatalogError(f"no {tokens[1].lower()} {name!r}")
            if tokens[1].is_("DATABASE") and name in group and group[name].tables and not cascade:
                raise CatalogError(f"database {name!r} isn't empty")
            if tokens[1].is_("DATABASE") and name == self.catalog.current:
                raise CatalogError(f"database {name!r} is in use")
            group.pop(name, None)
        return self._done()

    def _do_alter(self, tokens: list[Token]) -> DataFrame:
        table, rest = str(tokens[2]), [t for t in tokens[3:] if not t.is_("COLUMN")]
        if rest[0].is_("ADD"):
            changes.add_column(self.catalog, table, self._column(rest[1:]))
        elif rest[0].is_("DROP"):
            changes.drop_column(self.catalog, table, str(rest[1]))
        else:
            changes.rename_column(self.catalog, table, str(rest[1]), str(rest[3]))
        return self._done()

    # ------------------------------------------------------------ administration

    def _do_show(self, tokens: list[Token]) -> DataFrame:
        what = tokens[1].upper()
        if what in ("EDGE", "COLUMNS"):
            return self.catalog.show("EDGE TYPES" if what == "EDGE" else what, str(tokens[-1]))
        if what in ("DATABASES", "TABLES", "INDEXES", "EMBEDDINGS", "PROVIDERS"):
            return self.catalog.show(what)
        if what == "BACKFILL":
            rows = [(t.name, c.name, t.data.where(F.col(c.name).isNull()).count()) for t in self.catalog.db.tables.values() for c in t.columns if c.embedding]
            return self.spark.createDataFrame(rows, "table string, column string, missing long")
        settings = sorted((k, v) for k, v in dict(self.spark.sparkContext.getConf().getAll()).items() if k.startswith("spark.sql"))
        if what == "ALL":
            return self.spark.createDataFrame(settings, "name string, setting string")
        return self.spark.createDataFrame([(tokens[1].lower(), self.spark.conf.get(f"skein.{tokens[1].lower()}", None))], "name string, setting string")

    def _do_describe(self, tokens: list[Token]) -> DataFrame:
        return self.catalog.describe(str(tokens[-1]))

    def _do_set(self, tokens: list[Token]) -> DataFrame:
        self.spark.conf.set(f"skein.{tokens[1].lower()}", str(_value(tokens[3:]) if tokens[3].kind != "word" else tokens[3]))
        return self._done()

    def _do_use(self, tokens: list[Token]) -> DataFrame:
        if tokens[-1] not in self.catalog.databases:
            raise CatalogError(f"no database {tokens[-1]!r}")
        self.catalog.use(str(tokens[-1]))
        return self._done()

    def _do_analyze(self, tokens: list[Token]) -> DataFrame:
        """Row and distinct counts and NULL shares of a table's columns."""
        meta = self.catalog.table(tokens[-1])
        plain = [c.name for c in meta.columns if not c.embedding]
        row = meta.data.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in plain], *[F.avg(F.col(c).isNull().cast("double")).alias(f"z_{c}") for c in plain]).first()
        return self.spark.createDataFrame([(c, row["n"], row[f"d_{c}"], row[f"z_{c}"]) for c in plain], "column string, rows long, distinct_values long, null_fraction double")

    def _do_vacuum(self, tokens: list[Token]) -> DataFrame:
        return self._done()  # snapshots hold no dead versions

    def _do_reindex(self, tokens: list[Token]) -> DataFrame:
        for i in self.catalog.db.indexes.values():
            i.cached = None
        return self._done()

    def _embeddings(self, table: str, again: bool, options: list[Token]) -> DataFrame:
        """Embeddings of a table's columns; BATCH n texts at a time, RATE_LIMIT n calls of a provider a second in each task."""
        numbers = {t.upper(): int(next(x for x in options[k + 1 :] if x.kind == "number")) for k, t in enumerate(options) if t.is_("BATCH", "RATE_LIMIT")}
        batch, rate = numbers.get("BATCH"), numbers.get("RATE_LIMIT")
        meta, n = self.catalog.table(table), 0
        for c in meta.columns:
            if c.embedding:
                n += meta.data.count() if again else meta.data.where(F.col(c.name).isNull()).count()
                fill = provider.reembed if again else provider.backfill
                changes._publish(meta, fill(meta.data, c.name, c.embedding[0], c.embedding[1], c.embedding[2], batch=batch, rate=rate))
        return self._count(n)

    def _do_reembed(self, tokens: list[Token]) -> DataFrame:
        return self._embeddings(str(tokens[2]), True, tokens[3:])

    def _do_backfill(self, tokens: list[Token]) -> DataFrame:
        return self._embeddings(str(tokens[3]), False, tokens[4:])

    def _do_begin(self, tokens: list[Token]) -> DataFrame:
        """Snapshots are immutable: a transaction remembers them and all metadata, and ROLLBACK puts them back."""
        if self._snapshot is not None:
            raise ValueError("a transaction is open")
        self._snapshot = self.catalog.snapshot()
        return self._done()

    def _do_commit(self, tokens: list[Token]) -> DataFrame:
        self._snapshot = None
        return self._done()

    def _do_rollback(self, tokens: list[Token]) -> DataFrame:
        if len(tokens) > 1 and tokens[1].is_("TO"):
            raise ValueError("savepoints are not supported")
        if self._snapshot is not None:
            self.catalog.restore(self._snapshot)
        self._snapshot = None
        return self._done()

    def _do_savepoint(self, tokens: list[Token]) -> DataFrame:
        raise ValueError("savepoints are not supported")

    _do_release = _do_savepoint
