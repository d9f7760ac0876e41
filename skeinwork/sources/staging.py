"""Tables in the shared folder that cut the lineage of iterative programs, and their deletion."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
HOT_KEYS = 4096


def staged(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` to the folder in ``spark.checkpoint.dir`` and read it back without its lineage.

    A session on one machine that names no folder gets a temporary one; on a cluster that is an error. ``by``
    names a column that the files are dealt and sorted by, so that a scan for few of its values skips most.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skein_stage_")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.repartitionByRange(by).sortWithinPartitions(by) if by else df).write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for path in [p for p in _written if folder.endswith(p.split(":", 1)[-1].lstrip("/"))]:
                _delete(path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are staged inside are deleted at the end, but for those put into the list."""
    before, keep = set(_written), []
    yield keep
    kept = [f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()]
    for path in [p for p in _written if p not in before and not any(k.endswith(p.split(":", 1)[-1].lstrip("/")) for k in kept)]:
        _delete(path)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may have ended before; then the folder's owner cleans it
            return


def join_hot(rows: DataFrame, table: DataFrame, on: str, times: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and, as ``times``, its number of rows.

    Keys of more than ``n_rows`` / ``HOT_KEYS`` rows, fewer than ``HOT_KEYS`` in all, are broadcast: no task gets
    all the rows of such a key. The others are joined by a shuffle.
    """
    limit = max(n_rows // HOT_KEYS, 64)
    hot, rest = table.where(F.col(times) > limit), table.where(F.col(times) <= limit)
    cold_rows = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(cold_rows.join(rest, on))
