"""Vectorised lookup of a text's segments in a growing table of encoded segments.

Texts are laid end to end as code points; a tokenizer marks where segments begin and end; each
segment's 64-bit hash is looked up in an open-addressing table held in numpy arrays. Segments not met
before are encoded once, in a batch. On a hit the segment's code points are compared with those that
the row was made from; a segment that only shares the hash is reported, and its text is encoded by other
means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from ._kernels import U, mix

SLICE_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        out = np.ones(max(n, SLICE_CHARS + 1), dtype=U)
        filled, step = 1, base % (1 << 64)
        while filled < len(out):
            more = min(filled, len(out) - filled)
            out[filled : filled + more] = out[:more] * U(step)
            filled += more
            step = step * step % (1 << 64)
        _powers[base] = got = out
    return got[:n]


def segment_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of segments; two segments may share one, so a hit is compared."""
    total = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum((codes.astype(U) + U(1)) * powers(_BASE, len(codes)), out=total[1:])
    hashed = (total[ends] - total[starts]) * powers(_INVERSE, len(codes) + 1)[starts]
    return mix(hashed + (ends - starts).astype(U) * U(0xFF51AFD7ED558CCD))


class HashIndex:
    """Well-mixed 64-bit keys to row numbers, by linear probing."""

    def __init__(self, bits: int) -> None:
        self.shift, self.keys, self.rows = U(64 - bits), np.zeros(1 << bits, dtype=U), np.full(1 << bits, -1, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        out = self.rows[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.rows) - 1)
            out[left] = self.rows[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[slot[left]] != keys[left])]
        return out

    def insert(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Add distinct keys that aren't there yet."""
        slot = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.rows[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.rows[slot[won]], self.keys[slot[won]] = rows[won], keys[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.rows) - 1)


class SegmentTable:
    """Segments' ids in one flat array; starts again from nothing when it is full."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 19) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index, self.n, self.used = HashIndex(self.limit.bit_length() + 1), 0, 0
        self.start, self.flat = np.zeros(self.limit + 1, dtype=np.int64), np.zeros(1 << 20, dtype=np.uint32)
        self.spelled_at, self.spelled = np.zeros(self.limit + 1, dtype=np.int64), np.zeros(1 << 20, dtype=np.uint32)

    def rows(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the segments, and which segments are not the ones those rows were made from.

        ``text`` holds the same code points as ``codes``.
        """
        hashed = segment_hashes(codes, starts, ends)
        out = self.index.find(hashed)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            fresh, first = np.unique(hashed[missing], return_index=True)
            if self.n + len(fresh) > self.limit:
                self.limit = max(self.limit, 2 * len(fresh))
                self.clear()
                return self.rows(codes, starts, ends, text)
            at = missing[first]
            ids, offsets = self.encode([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), dtype=np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[self.n : self.n + len(fresh) + 1] = offsets + self.used
            n = ends[at] - starts[at]
            spelled = self.spelled_at[self.n : self.n + len(fresh) + 1]
            spelled[1:] = np.cumsum(n) + spelled[0]
            if spelled[-1] > len(self.spelled):
                self.spelled = np.concatenate([self.spelled, np.zeros(max(len(self.spelled), int(n.sum())), dtype=np.uint32)])
            self.spelled[spelled[0] : spelled[-1]] = codes[_runs(starts[at], n)]
            self.index.insert(fresh, np.arange(self.n, self.n + len(fresh), dtype=np.int32))
            self.n, self.used = self.n + len(fresh), self.used + len(ids)
            out[missing] = self.index.find(hashed[missing])
        return out, self._strange(out, codes, starts, ends - starts)

    def _strange(self, rows: np.ndarray, codes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Segments that differ from the one of their row."""
        there = self.spelled_at[rows]
        strange = self.spelled_at[rows + 1] - there != n
        if strange.any():
            there = np.where(strange, 0, there)
            n = np.where(strange, 0, n)
        unlike = codes[_runs(starts, n)] != self.spelled[_runs(there, n)]
        if unlike.any():
            strange[np.repeat(np.arange(len(n)), n)[unlike]] = True
        return strange

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.start[rows + 1] - self.start[rows]

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """All ids of the segments, in order."""
        n = self.lengths(rows)
        first = np.cumsum(n) - n
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.start[rows] - first, n)]


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``n`` of each, one run after the other."""
    end = np.cumsum(n)
    return np.arange(int(end[-1]) if len(n) else 0) + np.repeat(starts - (end - n), n)


def text_slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows of about ``limit`` characters; None is empty."""
    first, group, chars = 0, [], 0
    for i, text in enumerate(texts):
        group.append(text or "")
        chars += len(group[-1])
        if chars >= limit:
            yield first, group
            first, group, chars = i + 1, [], 0
    if group:
        yield first, group


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, also of empty ones."""
    total = np.r_[0, np.cumsum(values)]
    return total[offsets[1:]] - total[offsets[:-1]]
