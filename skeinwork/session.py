"""Session settings and what executors need of this package."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, name: str = "skeinwork", **settings: str) -> SparkSession:
    """A session with the engine's settings: UTC, adaptive execution, Arrow transfer."""
    builder = SparkSession.builder.master(master).appName(name).config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, unless their path has it."""
    context = spark.sparkContext
    if context.applicationId in _shipped or any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(":")):
        return
    folder = tempfile.mkdtemp(prefix="skein_ship_")
    context.addPyFile(shutil.make_archive(f"{folder}/skeinwork", "zip", ROOT, "skeinwork"))
    _shipped.add(context.applicationId)
