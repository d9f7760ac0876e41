"""Operator 5: toxicity by weak supervision.

Voters look at a text and vote toxic (1), harmless (-1) or not at all (0): one for each strong term of
a lexicon learned from labelled rows (whole words, and word beginnings for inflected or compounded
ones, which may have to occur twice or four times), one for each group of weaker terms, a short general list of
insults, patterns that address a reader with one, counts and densities of hits, and the absence of any. Only
prose is voted harmless: of a text that says one thing over and over, or is full of signs, absence says less.

A generative label model fits the probability of every vote under both hidden classes by expectation
maximisation on a bounded sample, and the voters' correlations within a class; weights solved against
that correlation matrix keep voters that repeat each other from counting twice. A linear classifier
over the votes and hit statistics is then trained on the model's posterior labels, and scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fit import FIT_ROWS, held_out, labelled_sample
from ._store import documents, store

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
CANDIDATES, TERMS, STRONG, GROUPS = 20_000, 600, 24, 4
BEGINNINGS, OFTEN = (4, 5, 6, 7), (2, 4)  # characters of a word's beginning; how often it occurs in a text
MIN_TOXIC = 2
LIFT, SURPRISE = 3.4, 2.8  # a term is 30 times as frequent in toxic rows, and not by chance
MIN_SHARE, ASTRAY = 0.012, 0.05  # least share of toxic rows that hold it; hits in others for each hit in those
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting dumb imbecile garbage filth filthy vermin clown bastard bitch whore shit fuck fucking asshole retard cretin".split())
PROSE, SIGNS = 2.0, 0.1  # least distinct words for the root of all, most signs a word
_WORD = re.compile(r"[^\W\d_]+").findall
_ADDRESS = re.compile(r"\b(?:you(?:['’]re| are)?|tu es|vous êtes|du bist|eres|stop being|such)\s+(?:an?\s+|un[ea]?\s+|ein[e]?\s+)?([^\W\d_]+)").findall


def _expand(found: dict[str, int]) -> set[str]:
    """Terms of counted words: the words, ^ and the beginnings of longer ones, and those that occur often."""
    begun: Counter = Counter()
    for w, n in found.items():
        for k in BEGINNINGS:
            if len(w) <= k:
                break
            begun[w[:k]] += n
    out = set(found)
    out.update("^" + b for b in begun)
    for k in OFTEN:
        out.update(f"{k}^{b}" for b, n in begun.items() if n >= k)
    return out


def _terms(text: str) -> set[str]:
    """A text's distinct terms."""
    return _expand(Counter(_WORD(text.lower())))


@dataclass
class Voters:
    """The lexicon by voter, and what is read off a text."""

    strong: list[str]
    groups: list[frozenset[str]]
    lexicon: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        stems = {t.split("^")[-1] for t in self.lexicon}
        self.heads = frozenset(w[:3] for w in stems | INSULTS)
        self.words = frozenset(t for t in self.lexicon if "^" not in t) | INSULTS
        self.beginnings = tuple({t.split("^")[1] for t in self.lexicon if "^" in t})

    @property
    def n(self) -> int:
        return len(self.strong) + len(self.groups) + 6

    def read(self, text: str | None) -> tuple[list[int], list[float]]:
        """Votes and features of one text."""
        low = (text or "").lower()
        found = Counter(_WORD(low))
        heads = self.heads
        some = {w: n for w, n in found.items() if w[:3] in heads}  # no other word can be part of a term
        terms = _expand(some) if some else set()
        hits, insults = self.lexicon & terms, INSULTS & terms
        n_words = sum(found.values())
        hit = {w for w in some if w in self.words or w.startswith(self.beginnings)} if hits or insults else set()
        hit_words = sum(some[w] for w in hit)
        votes = [1 if t in terms else 0 for t in self.strong] + [1 if g & terms else 0 for g in self.groups]
        addressed = bool(hit) and any(w in hit for w in _ADDRESS(low))
        density = hit_words / max(n_words, 1)
        prose = n_words >= 10 and len(found) >= PROSE * n_words**0.5 and sum(map(low.count, "!|#$%&*")) < SIGNS * n_words
        votes += [1 if insults else 0, 1 if addressed else 0, 1 if hit_words >= 2 else 0, 1 if density >= 0.005 else 0, -1 if not hit_words else 0, -1 if not hit_words and prose else 0]
        return votes, [np.log1p(hit_words), np.log1p(1000 * density), np.log1p(len(hits)), np.log1p(n_words) / 10 * bool(hit_words)]

    def table(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.read(t) for t in texts]
        return np.array([v for v, _ in got], dtype=np.int8).reshape(-1, self.n), np.array([f for _, f in got], dtype=float).reshape(-1, 4)


def learn_voters(sample: DataFrame) -> Voters:
    """The lexicon from document frequencies of terms in labelled rows: at most ``TERMS`` terms.

    Terms are taken from toxic rows first (at most ``CANDIDATES``, the most frequent ones), and only
    those are counted in the others.
    """

    def counted(only: set[str] | None):
        def run(batches):
            total: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    terms = _terms(text or "")
                    total.update(terms if only is None else terms & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

        return run

    toxic = sample.where("label = 1").select("text").mapInArrow(counted(None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TOXIC)
    inside = {r.term: r.n for r in toxic.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    rest = sample.where("label = 0").select("text").mapInArrow(counted(set(inside)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    outside = {r.term: r.n for r in rest.collect()}  # at most ``CANDIDATES`` rows
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    return choose(inside, outside, n)


def choose(inside: dict[str, int], outside: dict[str, int], n: dict[int, int]) -> Voters:
    """The voters from numbers of toxic and of other rows that hold a term; ties go by the term's spelling."""
    if not n.get(1) or not n.get(0):
        return Voters([], [], frozenset())

    def lift(t: str) -> float:
        return np.log((inside[t] + 0.5) / (n[1] + 1)) - np.log((outside.get(t, 0) + 0.5) / (n[0] + 1))

    def surprise(t: str) -> float:
        """How far the term's count in toxic rows lies above what its overall rate explains, in deviations."""
        rate = (inside[t] + outside.get(t, 0) + 1) / (n[0] + n[1] + 2)
        return (inside[t] - n[1] * rate) / np.sqrt(n[1] * rate * (1 - rate))

    good = [t for t in inside if inside[t] >= MIN_TOXIC and lift(t) > LIFT and surprise(t) > SURPRISE and inside[t] >= MIN_SHARE * n[1] and outside.get(t, 0) <= ASTRAY * inside[t]]
    good = sorted(good, key=lambda t: (-inside[t] * min(lift(t), 6.0), t))[:TERMS]
    groups = [frozenset(good[STRONG + k :: GROUPS]) for k in range(GROUPS)]
    return Voters(good[:STRONG], groups, frozenset(good))


@dataclass
class LabelModel:
    """Weights of votes in the log odds of the hidden label."""

    weights: np.ndarray
    bias: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weights + self.bias, -30, 30)))


def fit_label_model(votes: np.ndarray, share: float, rounds: int = 50) -> tuple[LabelModel, np.ndarray]:
    """(model, correlations): vote rates by expectation maximisation, weights against within-class correlations.

    ``share`` is the toxic class's share, by which the first posteriors are drawn from the votes' sums.
    """
    x = votes.astype(float)
    total = x.sum(axis=1)
    p = np.where(total > 0, 0.9, share / 10)
    values = (-1, 0, 1)
    is_value = [x == v for v in values]
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        log = [np.log(np.stack([(w @ m + 0.5) / (w.sum() + 1.5) for m in is_value])) for w in (1 - p, p)]
        odds = np.log(prior / (1 - prior)) + sum(is_value[k] @ (log[1][k] - log[0][k]) for k in range(3))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    means = [(w[:, None] * x).sum(axis=0) / max(w.sum(), 1e-9) for w in (1 - p, p)]
    spread = sum(((x - m) * w[:, None]).T @ (x - m) for w, m in zip((1 - p, p), means, strict=True)) / len(x)
    deviation = np.sqrt(np.diag(spread) + 1e-3)
    correlations = spread / np.outer(deviation, deviation)
    shrunk = 0.7 * correlations + 0.3 * np.eye(len(correlations)) + 1e-3 * np.eye(len(correlations))
    weights = np.linalg.solve(shrunk, (means[1] - means[0]) / deviation) / deviation
    at = x @ weights
    # the threshold and slope that agree best with the posteriors: one-dimensional logistic regression
    slope, bias = _logistic(at[:, None] / max(at.std(), 1e-9), p, np.ones(len(p)), 1e-4)
    return LabelModel(weights * slope[0] / max(at.std(), 1e-9), bias), correlations


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by damped Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) * np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty * w
        curvature = (a * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


@dataclass
class Toxicity:
    voters: Voters
    label_model: LabelModel
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        votes, features = self.voters.table(texts)
        return 1 / (1 + np.exp(-np.clip(np.c_[votes, features] @ self.weights + self.bias, -30, 30)))


def fit(sample: DataFrame) -> Toxicity:
    """All three steps on (text, label) rows of bounded number; only the lexicon and the share use the labels."""
    voters = learn_voters(sample)

    def run(batches):
        for batch in batches:
            votes, features = voters.table(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(votes.astype(float)), pa.list_(pa.float64())), pa.array(list(features), pa.list_(pa.float64())), batch.column(1)], ["votes", "features", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "votes array<double>, features array<double>, label int").collect()  # at most about FIT_ROWS
    if not rows:
        return Toxicity(voters, LabelModel(np.zeros(voters.n), -2.0), np.zeros(voters.n + 4), -2.0, np.zeros(voters.n))
    rows.sort(key=lambda r: (r.votes, r.features, r.label))
    return train(voters, np.array([r.votes for r in rows]), np.array([r.features for r in rows]), np.array([r.label for r in rows]))


def train(voters: Voters, votes: np.ndarray, features: np.ndarray, labels: np.ndarray) -> Toxicity:
    """The label model on votes, and the linear classifier on its posteriors; of the labels only their mean is used."""
    label_model, _ = fit_label_model(votes, float(labels.mean()))
    soft = label_model.posterior(votes)
    weights, bias = _logistic(np.c_[votes, features], soft, np.ones(len(soft)), 1e-4)
    sure = np.abs(votes) > 0
    accuracies = np.where(sure, np.where(votes > 0, soft[:, None], 1 - soft[:, None]), 0).sum(axis=0) / np.maximum(sure.sum(axis=0), 1)
    return Toxicity(voters, label_model, weights, bias, accuracies)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``CUT``) for every row of ``docs``.

    The fit uses about ``fit_rows`` labelled rows outside the held-out fold; without any, every score
    is low. Of an id with several labels the greatest counts, of one with several texts each. Null and empty
    texts hold no hit and score as such; equal texts get equal scores (terms that are equally strong are
    taken by their spelling); very long texts are read whole. A null id is not held out. An empty table gives an
    empty result; other columns are ignored, whatever their names. Texts are scored in one narrow pass.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    model = fit(store(labelled_sample(source, labels, "toxic", FOLDS, HELD_OUT, fit_rows).select("text", "label"), "toxic_sample"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.score(batch.column(1).to_pylist()))], ["id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"))
    scored = scored.mapInArrow(run, f"id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
