"""Table-valued graph functions by name, with checked parameters."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import algorithms

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


class AlgorithmRegistry:
    """name -> fn(edges, **parameters) -> DataFrame; open to additions."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, function: Callable[..., DataFrame]) -> None:
        self.functions[name.lower()] = function

    def call(self, name: str, edges: DataFrame, **parameters) -> DataFrame:
        function = self.functions.get(name.lower())
        if function is None:
            raise ValueError(f"unknown algorithm {name!r}")
        known = list(inspect.signature(function).parameters)[1:]
        for p in parameters:
            if p not in known:
                raise ValueError(f"{name} has no parameter {p!r}")
        if dict(edges.dtypes)["src"] not in _INTEGERS:
            raise ValueError("algorithms need integer keys")
        return function(edges.withColumns({"src": edges["src"].cast("long"), "dst": edges["dst"].cast("long")}), **parameters)


REGISTRY = AlgorithmRegistry()
for _name in ("pagerank", "connected_components", "strongly_connected_components", "betweenness", "closeness", "harmonic", "degree_centrality", "eigenvector", "clustering_coefficient", "triangle_count", "community_detect"):
    REGISTRY.register(_name, getattr(algorithms, _name))
