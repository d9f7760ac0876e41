"""New rows of a streamed table get their embeddings as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..vector.provider import backfill


def embed_stream(rows: DataFrame, path: str, checkpoint: str, column: str, dim: int, sources: Sequence[str], provider: str = "builtin", once: bool = True) -> StreamingQuery:
    """Write ``rows`` with filled embeddings to parquet at ``path``; restarts go on where the last run ended."""
    writer = backfill(rows, column, dim, sources, provider).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
