"""BM25 ranking: postings and document lengths are derived tables, a search is a join with its terms.

Texts are cut into tokens by built-in functions and counted; only distinct tokens are stemmed in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .analyzer import STOP_WORDS, analyze, stems, terms

K1, B = 1.2, 0.75


@dataclass
class BM25Index:
    """postings (doc, term, tf, dl) of one text column and the numbers of its documents."""

    postings: DataFrame
    n: int
    average_length: float
    stemming: bool
    stop_words: bool

    def search(self, query: str) -> DataFrame:
        """(doc, _score) of the documents with any distinct term of the query."""
        wanted = sorted(set(analyze(query, self.stemming, self.stop_words)))
        hits = self.postings.where(F.col("term").isin(*wanted)) if wanted else self.postings.where("false")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf, length = F.col("tf").cast("double"), F.col("dl") / F.lit(self.average_length or 1.0)
        score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        return hits.join(F.broadcast(df), "term").groupBy("doc").agg(F.sum(score).cast("float").alias("_score"))  # a row a query term


def index(table: DataFrame, pk: str, column: str, stemming: bool = True, stop_words: bool = True, keep: bool = False) -> BM25Index:
    """Index every non-NULL text of ``column``; texts without terms count as documents too.

    With ``keep`` the postings are written, dealt and sorted by term, for more than one search.
    """
    docs = table.where(F.col(column).isNotNull()).select(F.col(pk).alias("doc"), terms(F.col(column), stop_words).alias("terms"))
    if stemming:
        counted = docs.select("doc", F.explode("terms").alias("token")).groupBy("doc", "token").agg(F.count("*").alias("tf"))
        known = counted.select("token").distinct().select("token", stems(F.col("token")).alias("term"))
        known = known.where(~F.col("term").isin(*sorted(STOP_WORDS))) if stop_words else known
        postings = counted.join(known, "token").groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
        lengths = postings.groupBy("doc").agg(F.sum("tf").cast("int").alias("dl"))
        postings = postings.join(lengths, "doc").select("doc", "term", "dl", "tf")
        n, total = docs.count(), None
    else:
        sized = docs.withColumn("dl", F.size("terms"))
        postings = sized.select("doc", "dl", F.explode("terms").alias("term")).groupBy("doc", "term", "dl").agg(F.count("*").alias("tf"))
        totals = sized.agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
        n, total = totals["n"], totals["total"]
    postings = staged(postings, "postings", by="term") if keep else postings
    if total is None:
        total = postings.agg(F.sum("tf").alias("total")).first()["total"]
    return BM25Index(postings, n, (total or 0) / n if n else 0.0, stemming, stop_words)


def match(table: DataFrame, pk: str, column: str, query: str, where: str | None = None, stemming: bool = True, stop_words: bool = True, indexed: BM25Index | None = None) -> DataFrame:
    """Rows of ``table`` that hold a term of ``query``, with ``_score``; order by it descending, then by key."""
    hits = (indexed or index(table, pk, column, stemming, stop_words)).search(query)
    out = table.join(hits, table[pk] == hits["doc"]).drop("doc")
    return out.where(where) if where else out
