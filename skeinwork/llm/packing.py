"""Operator 6: best-fit packing of token sequences by a configuration linear program.

The histogram of piece lengths (at most ``capacity`` rows) is all that the driver sees. Its lengths
form at most ``CLASSES`` size classes. A configuration says how many pieces of each class share one
sequence. The covering program over all configurations is solved by multiplicative weights: each round
prices the classes by how little of their demand is covered, starting from their volume, and a knapsack by
dynamic programming over the capacity finds the dearest configuration. Rounding takes whole copies of the
configurations, of the actual lengths in their classes. Those are a little shorter than their class's
greatest one, so a knapsack over single lengths, with the length as its price, fills the room, in place of as
few of the copy's smallest pieces as makes it full; a copy that can't be made full isn't taken. What the
copies leave is covered by further copies, each the longest piece that is left and the knapsack's filling of
the rest. No other heuristic takes part.

A plan is a bounded list of patterns, each standing for any number of like sequences; a piece finds its
sequence from its rank among the pieces of its length. Ranks come from per-partition counters and one
running sum over partitions, never from one sorted group.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import documents, store, tune
from .word_bpe import shared, tokenizer_path

CLASSES = 128
ROUNDS = 400
STEP = 0.05


def price(sizes: np.ndarray, weights: np.ndarray, capacity: int, most: np.ndarray | None = None) -> np.ndarray:
    """Counts of each size, at most ``most`` of it, in the configuration of greatest weight: a knapsack."""
    best, took = np.zeros(capacity + 1), []
    for i, (size, weight) in enumerate(zip(sizes.tolist(), weights.tolist(), strict=True)):
        left, k = capacity // size if most is None else min(capacity // size, int(most[i])), 1
        while left > 0:  # any number up to ``left`` is a sum of 1, 2, 4, .. and a rest
            k = min(k, left)
            other = best[: capacity + 1 - k * size] + k * weight
            better = other > best[k * size :]
            took.append((i, k, k * size, better))
            best[k * size :][better] = other[better]
            left, k = left - k, 2 * k
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for i, k, length, better in reversed(took):
        if c >= length and better[c - length]:
            counts[i] += k
            c -= length
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[float, np.ndarray]]:
    """(copies, counts by size) of a fractional cover, by multiplicative weights."""
    cover = np.zeros(len(sizes))
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        counts = price(sizes, sizes * np.exp(-(cover - cover.min()) / STEP / 4), capacity, demand)
        used = counts > 0
        copies = STEP * (demand[used] / counts[used]).min()
        found.setdefault(counts.tobytes(), [0.0, counts])[0] += copies
        cover = cover + copies * counts / demand
        if cover.min() >= 1:
            break
    scale = 1 / max(np.average(cover, weights=sizes * demand), 1e-9)  # the volume is covered once
    return sorted(((x * scale, counts) for x, counts in found.values()), key=lambda p: -p[0])


def fill(lengths: np.ndarray, left: np.ndarray, room: int, taken: dict[int, int]) -> dict[int, int]:
    """Pieces that fill ``room`` as far as it can be filled, beside those ``taken``: number by index of the length.

    A knapsack whose prices are the lengths, over the bits of one integer; long lengths come first, and no
    more lengths than the room needs.
    """
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for i in range(int(np.searchsorted(lengths, room, side="right")) - 1, -1, -1):
        size, n, k = int(lengths[i]), min(int(left[i]) - taken.get(i, 0), room // int(lengths[i])), 1
        while n > 0:
            k = min(k, n)
            steps.append((i, k, k * size, reach))
            reach |= reach << k * size & mask
            n, k = n - k, 2 * k
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    for i, k, length, before in reversed(steps):
        if not before >> at & 1:
            out[i] += k
            at -= length
    return dict(out)


def _take(lengths: np.ndarray, left: np.ndarray, pieces: dict[int, int], most: int) -> tuple[int, dict[int, int]]:
    """As many like sequences as the pieces allow, at most ``most``: (number, pieces by length)."""
    n = min(most, *(int(left[i]) // k for i, k in pieces.items()))
    for i, k in pieces.items():
        left[i] -= k * n
    return n, {int(lengths[i]): k for i, k in pieces.items()}


def rounded(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Whole copies of the program's configurations, taken out of ``left``."""
    edges = np.unique(np.linspace(0, len(lengths), min(CLASSES, len(lengths)) + 1).astype(int))
    parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    sizes = np.array([lengths[p][-1] for p in parts])
    demand = np.array([left[p].sum() for p in parts])
    out = []
    for copies, counts in configurations(sizes, demand, capacity):
        used, n = np.flatnonzero(counts)[::-1], int(np.ceil(copies))
        while n > 0 and all(left[parts[c]].sum() >= counts[c] for c in used):
            pieces: dict[int, int] = {}
            for c in used:
                want = int(counts[c])
                for i in range(parts[c].stop - 1, parts[c].start - 1, -1):
                    got = min(want, int(left[i]))
                    if got:
                        pieces[i] = got
                        want -= got
                    if not want:
                        break
            while True:  # full with its smallest piece, else with another in its place, else with others for the two smallest, ..
                room = capacity - sum(int(lengths[i]) * k for i, k in pieces.items())
                more = fill(lengths, left, room, pieces)
                room -= sum(int(lengths[i]) * k for i, k in more.items())
                if not room or not pieces:
                    break
                least = min(pieces)
                pieces[least] -= 1
                if not pieces[least]:
                    del pieces[least]
            if not pieces:
                break
            for i, k in more.items():
                pieces[i] = pieces.get(i, 0) + k
            out.append(_take(lengths, left, pieces, n))
            n -= out[-1][0]
    return out


def rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Further copies for all that is in ``left``: its longest piece and the best filling each time."""
    out = []
    for i in range(len(lengths) - 1, -1, -1):
        while left[i]:
            pieces = fill(lengths, left, capacity - int(lengths[i]), {i: 1})
            pieces[i] = pieces.get(i, 0) + 1
            out.append(_take(lengths, left, pieces, int(left[i])))
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each length in one of them) for all pieces."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    return rounded(lengths, left, capacity) + rest(lengths, left, capacity)


def _places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks of its runs, pieces a sequence, first sequence and offset of each run."""
    rows, first, ranks = defaultdict(list), 0, defaultdict(int)
    for n, held in patterns:
        at = 0
        for length in sorted(held, reverse=True):
            rows[length].append((ranks[length], held[length], first, at))
            ranks[length] += n * held[length]
            at += length * held[length]
        first += n
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for length, r in rows.items()}


def token_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text, with their rank among those of their length in one partition."""

    def run(batches):
        bpe, counters, part = shared(tokenizer_path(tokenizer)), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc, k, at, len(piece), zlib.crc32(piece), part, int(counters[len(piece)])))
                    counters[len(piece)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (1, 5) else pa.int64()) for i, c in enumerate(columns)], ["id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is one piece of the end id alone. Rows with a null or repeated id are packed
    like any other. Very long texts are cut into pieces of ``capacity`` ids; ties (pieces of equal length) take
    any order. An empty table gives an empty result. Other columns are ignored. Texts are read once; afterwards only the pieces' numbers move, with one shuffle by (partition, length).
    """
    tune(df.sparkSession)
    spark = df.sparkSession
    pieces = store(token_pieces(df, id_col, text_col, tokenizer, end_id, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = _places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    shared_places = spark.sparkContext.broadcast(places)  # bounded by capacity and the number of patterns, whatever the input

    def run(batches):
        table = shared_places.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                size = int(length[rows[0]])
                ranks, each, first, at = table[size]
                run_of = np.searchsorted(ranks, rank[rows], side="right") - 1
                within = rank[rows] - ranks[run_of]
                sequence[rows] = first[run_of] + within // each[run_of]
                offset[rows] = at[run_of] + within % each[run_of] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
