"""Sources and sinks: Spark's readers and writers, with schemas given rather than inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A lazily scanned table; filters and column selection reach the files."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}: one of {FORMATS}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema: inferring one reads the data twice")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")
