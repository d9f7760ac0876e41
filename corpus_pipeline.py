"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import near_dedup, packing, quality, secrets, substring_dedup
from skeinwork.llm._store import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of a lower quality score go: those that the classifier itself rejects.
LEAST_QUALITY = 0.5
#: Documents whose shingle sets have this Jaccard similarity, in percent, are near copies; op8's own 85 binds only its query.
NEAR_PERCENT = 80


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier scores below ``LEAST_QUALITY`` go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs.select(*COLUMNS), labels).where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near duplicates the least document stays.

    Rows of that id with equal texts stay once, those with other texts all stay, as do rows without an id.
    """
    docs = docs.select(*COLUMNS)
    groups = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(groups, F.col("doc_id") == F.col("_id")).drop("_id")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = kept.groupBy("doc_id", F.xxhash64("text").alias("_version"), F.length("text").alias("_length")).agg(F.max(F.struct("text", *rest)).alias("row"))
    return once.select("doc_id", "row.*").select(*COLUMNS).union(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages that an earlier document holds are cut out of the later ones."""
    return _with_length(substring_dedup.remove(docs.select(*COLUMNS)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets are replaced by a mask."""
    return _with_length(secrets.redact(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]
#: SQL can't express the classifier, the shingle components or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; what each returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
