"""What both classifiers share: the bounded sample of labelled rows and sums over partitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 30_000  # labelled rows that a fit uses at most, up to the spread of a hash


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def held_out(id_col: str, folds: int, out: int) -> Column:
    return F.coalesce(fold(id_col, folds) == out, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int = FIT_ROWS) -> DataFrame:
    """(id, text, label) of about ``rows`` labelled rows outside the held-out fold, chosen by a hash of the id.

    ``docs`` has id and text. The chosen ids are broadcast: there are at most about ``rows`` of them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(fold("id", folds) != out).groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.join(F.broadcast(chosen), "id")


def summed(df: DataFrame, columns: list[str], sums: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of a vector of ``size`` numbers; each partition sends one vector."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += sums(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "value"])

    out = np.zeros(size)
    for r in df.select(*columns).mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out
