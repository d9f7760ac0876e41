"""Operator 4: token counts of whole texts by rank-synchronous array merging (see word_bpe.py)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import documents, tune
from .word_bpe import shared, tokenizer_path


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for every row.

    Tokens are those that the tokenizers library gives for the whole text without added special
    tokens. A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give
    repeated results; very long texts are read whole, an empty table gives an empty result, ties don't
    arise; other columns are ignored, whatever their names. One narrow pass, no shuffle.
    """

    def run(batches):
        bpe = shared(tokenizer_path(tokenizer))
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            n = bpe.count(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"]
            )

    tune(df.sparkSession)
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
