"""Algorithms run the query behind an edge table once, however often they use the edges."""

import pytest
from pyspark.sql import functions as F

from skeinwork.graph import algorithms as A


@pytest.mark.parametrize("algorithm", [lambda e: A.eigenvector(e, iterations=1), A.connected_components])
def test_edge_query_runs_once(spark, algorithm):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        runs.add(1)
        return x

    e = spark.range(20).select(F.col("id").alias("edge_id"), seen.asNondeterministic()("id").alias("src"), (F.lit(99).cast("long")).alias("dst"))
    assert algorithm(e).count() == 21
    assert runs.value == 20
