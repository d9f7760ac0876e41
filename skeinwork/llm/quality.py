"""Operator 2: document quality by a regularised quadratic discriminant.

A text becomes ``len(FEATURES)`` transformed statistics (logarithms of counts, logits of shares), computed
on its bytes for many texts at once. Each class has a mean and a covariance shrunk towards the pooled
one and towards its diagonal; the Cholesky factors are computed once on the driver and travel with the
scoring function. A score is the logistic of the difference of the two log densities, half the
difference of the squared Mahalanobis distances and of the log determinants, over ``TEMPERATURE``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._fit import FIT_ROWS, held_out, labelled_sample, summed
from ._kernels import grouped_order, span_hashes, string_slices, words
from ._store import documents, fresh, tune
from ._tokens import sums

FOLDS, HELD_OUT = 3, 1
TOWARDS_POOLED, TOWARDS_DIAGONAL, FLOOR = 0.2, 0.05, 1e-2
TEMPERATURE = 4.0
_ROWS = 1024

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "longest_word", "letters", "capitals", "digits", "stops", "exclamations",
    "bars", "signs", "other_marks", "non_ascii", "spaces", "wordless", "capital_starts", "short_words", "long_words", "distinct", "neighbours_alike", "commonest", "repeated_lines", "words_a_line",
)
_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)], "capitals": range(65, 91), "digits": range(48, 58), "stops": b".,;:?", "exclamations": b"!", "bars": b"|",
    "signs": b"#$%&*@~^+=<>{}[]\\_/", "other_marks": b"\"'`()-", "non_ascii": range(128, 256), "spaces": [9, 10, 11, 12, 13, 32],
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 0.0, 1.0)
    return np.log((share + 0.002) / (1.002 - share))


def _repeated(owner: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of distinct values and the count of its commonest one."""
    order = grouped_order(owner, hashed)
    owner, hashed = owner[order], hashed[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])]) if len(owner) else np.zeros(0, dtype=np.int64)
    distinct, most = np.bincount(owner[new], minlength=n), np.zeros(n)
    np.maximum.at(most, owner[new], np.diff(np.r_[new, len(owner)]))
    return distinct, most


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, features): transformed statistics of every text; a null or empty one has no words."""
    parts = []
    for _, data, offsets in string_slices(column):
        starts, ends, first = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        n, length = np.diff(offsets), (ends - starts).astype(float)
        n_words, docs = np.diff(first), len(offsets) - 1
        owner = np.repeat(np.arange(docs), n_words)
        counts = {k: sums(t[data], offsets) for k, t in _TABLES.items()}
        some, per_word = np.maximum(n, 1), np.maximum(n_words, 1)
        mean = sums(length, first) / per_word
        spread = np.sqrt(np.maximum(sums(length**2, first) / per_word - mean**2, 0))
        longest = np.zeros(docs)
        np.maximum.at(longest, owner, length)
        lettered = sums(_TABLES["letters"][data], np.r_[starts, len(data)]) if len(starts) else np.zeros(0)
        distinct, most = _repeated(owner, hashes, docs)
        alike = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=docs)
        breaks = np.flatnonzero(data == 10)
        heads = np.unique(np.r_[offsets[:-1][n > 0], breaks + 1])
        heads = heads[heads < len(data)]
        tails = np.r_[heads[1:], len(data)]
        line_owner = np.searchsorted(offsets, heads, side="right") - 1
        lines = np.bincount(line_owner, minlength=docs)
        distinct_lines, _ = _repeated(line_owner, span_hashes(data, heads, tails), docs)
        share = {k: counts[k] / some for k in counts}
        parts.append(np.stack([
            np.log1p(n), np.log1p(n_words), np.log1p(lines), np.log1p(mean), np.log1p(spread), np.log1p(longest), _logit(share["letters"]),
            _logit(counts["capitals"] / np.maximum(counts["letters"], 1)), _logit(share["digits"]), _logit(counts["stops"] / per_word), _logit(counts["exclamations"] / per_word),
            _logit(counts["bars"] / per_word), _logit(counts["signs"] / per_word), _logit(counts["other_marks"] / per_word), _logit(share["non_ascii"]), _logit(share["spaces"]),
            _logit(sums(lettered == 0, first) / per_word), _logit(sums(_TABLES["capitals"][data[starts]], first) / per_word), _logit(sums(length <= 2, first) / per_word),
            _logit(sums(length > 24, first) / per_word), _logit(distinct / per_word), _logit(alike / per_word), _logit(most / per_word),
            _logit(1 - distinct_lines / np.maximum(lines, 1)), np.log1p(n_words / np.maximum(lines, 1)),
        ], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Two normal densities by their means and the inverse Cholesky factors of their covariances."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        far = [((z - self.means[k]) @ self.whiten[k].T) ** 2 for k in (0, 1)]
        difference = 0.5 * (far[0].sum(axis=1) - far[1].sum(axis=1) + self.log_det[0] - self.log_det[1]) + self.log_odds
        return 1 / (1 + np.exp(-np.clip(difference / TEMPERATURE, -60, 60)))


def fit(sample: DataFrame) -> Discriminant | None:
    """The discriminant of (text, label) rows from summed moments; None if a class has no rows."""
    d = len(FEATURES)
    size = 1 + d + d * d

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = statistics(batch.column(0)), batch.column(1).to_numpy()
        return np.concatenate([np.r_[(y == k).sum(), x[y == k].sum(axis=0), (x[y == k].T @ x[y == k]).ravel()] for k in (0, 1)])

    total = summed(sample, ["text", "label"], moments, 2 * size).reshape(2, size)
    n = total[:, 0]
    if (n == 0).any():
        return None
    means = total[:, 1 : 1 + d] / n[:, None]
    within = [total[k, 1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    centre = total[:, 1 : 1 + d].sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(sum(np.diag(w) for w in within) / n.sum(), FLOOR))
    pooled = (within[0] + within[1]) / n.sum() / np.outer(scale, scale)
    whiten, log_det = [], []
    for k in (0, 1):
        own = within[k] / max(n[k], 1) / np.outer(scale, scale)
        own = (1 - TOWARDS_POOLED) * own + TOWARDS_POOLED * pooled
        own = (1 - TOWARDS_DIAGONAL) * own + TOWARDS_DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(d)
        lower = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(lower))
        log_det.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, (means - centre) / scale, np.array(whiten), np.array(log_det), float(np.log(n[1] / n[0])))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_docs: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with one more, last column, a score from 0 to 1 for every text; fitted on ``fit_docs`` (default ``docs``).

    The column is ``_score``, or with further underscores if ``docs`` has a column of that name; all rows and
    columns stay. The fit uses about ``fit_rows`` labelled rows outside the held-out fold; of an id with several
    labels the greatest counts, of one with several texts each. Without labelled rows of both classes every score
    is 0.5. Null and empty texts are scored by their (zero) statistics, equal texts alike; very long ones are
    read whole, and an empty table stays empty. Texts are read in one narrow pass.
    """
    tune(docs.sparkSession)
    source = fit_docs if fit_docs is not None else docs
    source = source.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    model = fit(labelled_sample(source, labels, "quality", FOLDS, HELD_OUT, fit_rows))

    at, score_name = docs.columns.index("text"), fresh(docs, "_score")

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), _ROWS):  # in small pieces: neither side holds a large batch twice
                part = batch.slice(first, _ROWS)
                score = model.score(statistics(part.column(at))) if model else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*batch.schema.names, score_name])

    fields = [*docs.schema.fields, StructField(score_name, DoubleType())]
    return docs.mapInArrow(run, StructType(fields))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; see :func:`quality_scores`.

    A null id is not held out; a score of exactly 0.5 (a tie) is predicted 1; other columns are ignored.
    """
    scores = quality_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    return scores.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
