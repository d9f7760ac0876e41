"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, near_dedup, packing, piece_bpe, quality, secrets, substring_dedup, token_counts, toxicity, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": secrets.query,
    "op2_quality_classifier": quality.query,
    "op3_sentencepiece_codes": piece_bpe.query,
    "op4_token_counts": token_counts.query,
    "op5_toxicity": toxicity.query,
    "op6_best_fit_packing": packing.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_embedding_near_dedup": vector_dedup.query,
    "op10_document_fingerprints": fingerprints.query,
}
#: SQL can't express models, tokenizers, hashes of arrays or components: tests/llm compares with brute force.
ORACLE_SQL: dict[str, str] = {}
