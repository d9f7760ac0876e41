"""Exact nearest-neighbour search: distances as column expressions, top k by order and limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("COSINE", "L2", "DOT")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: Column, metric: str = "COSINE") -> Column:
    """COSINE: 1 - cosine; L2: the squared distance; DOT: the inner product itself."""
    metric = metric.upper()
    if metric == "DOT":
        return _dot(vector, query)
    if metric == "L2":
        return F.aggregate(F.zip_with(vector, query, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    if metric == "COSINE":
        lengths = F.sqrt(_dot(vector, vector)) * F.sqrt(_dot(query, query))
        return F.when(lengths > 0, 1.0 - _dot(vector, query) / lengths).otherwise(1.0)
    raise ValueError(f"unknown metric {metric!r}")


def nearest(table: DataFrame, column: str, k: int, query: Sequence[float], metric: str = "COSINE", pk: str | None = None, where: str | None = None, scope: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with ``_distance``; ties go to the least ``pk``.

    ``where`` is intersected with the k nearest rows (never refilled) unless ``prefilter``; ``scope``, a
    table of keys, restricts the search itself. NULL vectors are skipped; DOT sorts descending.
    """
    rows = table.where(F.col(column).isNotNull())
    if scope is not None:
        if pk is None:
            raise ValueError("a scope needs the table's key")
        rows = rows.join(scope.select(F.col(scope.columns[0]).alias(pk)).distinct(), pk, "left_semi").select(*table.columns)
    if prefilter and where:
        rows = rows.where(where)
    rows = rows.withColumn("_distance", distance(F.col(column), F.array(*[F.lit(float(x)) for x in query]), metric))
    order = [F.col("_distance").desc() if metric.upper() == "DOT" else F.col("_distance").asc(), *([F.col(pk).asc()] if pk else [])]
    top = rows.orderBy(*order).limit(k)
    return top.where(where) if where and not prefilter else top
