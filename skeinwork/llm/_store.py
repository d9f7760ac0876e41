"""Where intermediate results go: parquet files in the shared checkpoint folder.

``spark.checkpoint.dir`` names a folder that the driver and all executors share. A table written
there cuts the lineage and survives the loss of any executor. A session on one machine that doesn't
name one (tests) gets a temporary folder; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names, or a fresh local one in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="skein_ckpt_")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ``BATCH_ROWS``: whole texts make large batches, held on both sides."""
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "4")  # a table written in two parts needs no sort
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage.

    ``by`` names a column with few values, each of which :func:`drop_part` can delete by itself.
    """
    spark = df.sparkSession
    tune(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "lz4")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_part(df: DataFrame, part: str) -> None:
    """Delete the files of one value (``column=value``) of a table stored ``by`` that column."""
    files = [x for x in df.inputFiles() if f"/{part}/" in x]
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])
    reclaim(df.sparkSession)


def reclaim(spark: SparkSession) -> None:
    """Ask the driver's garbage collector to run: only then does Spark delete the shuffle files of plans carried out."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`store` that nothing reads any more, and old shuffle files."""
    for df in tables:
        files = df.inputFiles()
        if files:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])
    if tables:
        reclaim(tables[0].sparkSession)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that starts with ``name`` and that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


FILTER_WORDS = 1 << 18


def _place(hashed: str) -> tuple[Column, Column]:
    """The word of the filter that a key's hash belongs to, and its three bits there."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, k).bitwiseAND(63).cast("int")) for k in (40, 46, 52)]
    return F.col(hashed).bitwiseAND(FILTER_WORDS - 1), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def with_hint(rows: DataFrame, key: list[Column], keys: DataFrame, hint: str) -> DataFrame:
    """``rows`` with a boolean ``hint`` that is false only where no row of ``keys`` equals ``key``, types included.

    A Bloom filter of at most ``FILTER_WORDS`` words of 64 bits is broadcast, however many keys there are; the more
    there are, the more rows without one it lets through, so a join has to follow.
    """
    hashed, word, held = (fresh(rows, name) for name in ("_hashed", "_word", "_held"))
    own, marks = _place(hashed)
    table = keys.select(F.xxhash64(*keys.columns).alias(hashed)).select(own.alias(word), marks.alias(held)).groupBy(word).agg(F.bit_or(held).alias(held))
    joined = rows.withColumn(hashed, F.xxhash64(*key)).join(F.broadcast(table), own == F.col(word), "left")
    return joined.withColumn(hint, F.coalesce(F.col(held).bitwiseAND(marks) == marks, F.lit(False))).drop(hashed, word, held)


def sift(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those whose key ``on`` isn't in ``table``, so that a join moves fewer of them."""
    hint = fresh(rows, "_hint")
    return with_hint(rows, [F.col(c) for c in on], table.select(*on), hint).where(hint).drop(hint)


HOT_KEYS = 4096


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], times: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key of ``on`` once and, as ``times``, its number of rows.

    Keys of more than ``n_rows`` / ``HOT_KEYS`` rows, of which there are fewer than ``HOT_KEYS``, are broadcast, so
    that no task gets all the rows of such a key; the others are joined by a shuffle.
    """
    limit = max(n_rows // HOT_KEYS, 64)
    hot, rest = table.where(F.col(times) > limit), table.where(F.col(times) <= limit)
    cold_rows = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(cold_rows.join(rest, on))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before; then the folder's owner cleans it
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
