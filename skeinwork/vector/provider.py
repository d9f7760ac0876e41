"""Embedding providers: one built in, which hashes words; others can be registered."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_WORDS = re.compile(rb"[A-Za-z0-9]+").findall


def builtin(texts: Sequence[str], dim: int) -> list[list[float] | None]:
    """Sum over words of hashed directions, scaled to length 1; None for a text without words.

    Component d of a word: FNV-1a of its bytes, seeded with the offset xor d * 2654435761; its upper 31
    bits over half of the greatest 32-bit integer.
    """
    seeds = np.uint64(_OFFSET) ^ (np.arange(dim, dtype=np.uint64) * np.uint64(2654435761))
    known: dict[bytes, np.ndarray] = {}
    out: list[list[float] | None] = []
    for text in texts:
        total = np.zeros(dim)
        found = _WORDS((text or "").lower().encode())
        for w in found:
            if w not in known:
                h = seeds.copy()
                for byte in w:
                    h = (h ^ np.uint64(byte)) * np.uint64(_PRIME)
                known[w] = (h >> np.uint64(33)).astype(np.int64).astype(np.int32) / float(0x7FFFFFFF >> 1)
            total += known[w]
        length = np.linalg.norm(total)
        out.append((total / length).astype(np.float32).tolist() if found and length > 0 else None)
    return out


PROVIDERS: dict[str, Callable[[Sequence[str], int], list]] = {"builtin": builtin}


def register_provider(name: str, function: Callable[[Sequence[str], int], list]) -> None:
    PROVIDERS[name] = function


def embed(text: Column, dim: int, provider: str = "builtin", batch: int | None = None, rate: float | None = None, retries: int = 3) -> Column:
    """Embeddings of a text column in Arrow batches.

    ``batch`` bounds the texts of one call of the provider, ``rate`` its calls a second in each task. A call that
    fails is tried again up to ``retries`` times, after waits that double from a tenth of a second.
    """
    function = PROVIDERS[provider]

    def call(texts: list[str]) -> list:
        for k in range(retries + 1):
            try:
                return function(texts, dim)
            except (OSError, TimeoutError):
                if k == retries:
                    raise
                time.sleep(0.1 * 2**k)
        return []

    @F.pandas_udf("array<float>")
    def run(texts):
        every, out, size = texts.tolist(), [], batch or max(len(texts), 1)
        for at in range(0, len(every), size):
            began = time.monotonic()
            out += call(every[at : at + size])
            if rate and at + size < len(every):
                time.sleep(max(0.0, 1 / rate - (time.monotonic() - began)))
        return type(texts)(out)

    return run(text)


def source_text(*columns: str) -> Column:
    """The named columns joined by one space; NULL and empty ones are skipped."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])


def reembed(df: DataFrame, column: str, dim: int, sources: Sequence[str], provider: str = "builtin", **calls: float | None) -> DataFrame:
    """Every embedding made anew."""
    return df.withColumn(column, embed(source_text(*sources), dim, provider, **calls))


def backfill(df: DataFrame, column: str, dim: int, sources: Sequence[str], provider: str = "builtin", **calls: float | None) -> DataFrame:
    """Missing embeddings filled; the others stay."""
    return df.withColumn(column, F.coalesce(F.col(column), embed(F.when(F.col(column).isNull(), source_text(*sources)), dim, provider, **calls)))
