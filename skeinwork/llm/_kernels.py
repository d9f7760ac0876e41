"""Vectorised text kernels over Arrow string buffers: words, 5-word shingles and their hashes.

All work is done on the UTF-8 bytes with numpy, for a whole slice of documents at once. A word is a
maximal run of bytes other than space and 0x09-0x0D; A-Z count as lower case. A word is read eight
bytes at a time; each eight bytes, mixed under a key of their place, are added up and mixed again.
Words of up to eight bytes and equal length never share a hash; others do with a chance of 2**-64,
whatever their pattern (a polynomial modulo 2**64 would give all Thue-Morse words of one length one hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20
SHINGLE = 5
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA5CB9243F2CE4F1B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_PLACES = mix(np.arange(1, 4097, dtype=U) * U(0x9E3779B97F4A7C15))


def string_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``limit`` bytes; null is empty.

    Only ``rows`` rows are copied at a time, so that a batch is not held twice.
    """
    for base in range(0, len(column), rows):
        part = pc.fill_null(column.slice(base, rows).cast(pa.large_string()), "")
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(part.buffers()[2] or b"", dtype=np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            yield base + first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word."""
    inside = _IN_WORD[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z as lower case."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    low = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=low[: len(data)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=low, strides=(1,))  # the eight bytes from every place on
    n = ends - starts
    parts = np.maximum((n + 7) >> 3, 1)
    total = mix((eight[starts] & _MASKS[np.minimum(n, 8)]) ^ _PLACES[0])
    more = np.flatnonzero(parts > 1)
    if len(more):
        count = parts[more] - 1
        first = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(first, count) + 1
        at = np.repeat(starts[more], count) + 8 * place
        left = np.minimum(np.repeat(n[more], count) - 8 * place, 8)
        keys = _PLACES[place & 4095] + (place >> 12).astype(U) * U(0xA0761D6478BD642F)
        total[more] += np.add.reduceat(mix((eight[at] & _MASKS[left]) ^ keys), first)
    return mix(total + n.astype(U) * U(0xFF51AFD7ED558CCD))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive values, by doubling; run i starts at value i."""
    size, x = 1, hashes
    while 2 * size <= n and len(x) > size:
        x = mix(x[: len(x) - size] + mix(x[size:] ^ _PLACES[size]))
        size *= 2
    if len(hashes) < n:
        return np.zeros(0, dtype=U)
    return mix(x[: len(x) - (n - size)] + mix(x[n - size :] ^ _PLACES[n])) if n > size else x


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every 5-word shingle; a document of fewer words has one of all of them."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    out_owner, out = [], []
    if len(hashes) >= SHINGLE:
        keep = np.flatnonzero(owner[: len(owner) - SHINGLE + 1] == owner[SHINGLE - 1 :])
        total = hashes[keep] * _STEPS[0]
        for k in range(1, SHINGLE):
            total += hashes[keep + k] * _STEPS[k]
        out_owner.append(owner[keep])
        out.append(mix(total))
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        total = n[few].astype(U) * U(0xC4CEB9FE1A85EC53)
        for k in range(SHINGLE - 1):
            has = n[few] > k
            total[has] += hashes[first[:-1][few[has]] + k] * _STEPS[k]
        out_owner.append(few)
        out.append(mix(total))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    return np.concatenate(out_owner), np.concatenate(out)


def grouped_order(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An order by owner (ascending already or not) that puts equal values of one owner side by side."""
    if not len(owner):
        return np.zeros(0, dtype=np.int64)
    bits = int(owner.max()).bit_length()
    if bits > 30:
        return np.lexsort((values, owner))
    keys = (owner.astype(U) << U(64 - bits) if bits else np.zeros(len(owner), dtype=U)) | (values >> U(bits))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    if (values[order[1:]][same] != values[order[:-1]][same]).any():  # unlike values with equal leading bits
        return np.lexsort((values, owner))
    return order


def distinct_sets(owner: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each of ``n`` owners, and the owners' offsets in them."""
    order = grouped_order(owner, hashed)
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    owner, hashed = owner[new], hashed[new]
    return hashed, np.searchsorted(owner, np.arange(n + 1))


def set_digests(hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit digests of each set, whatever its order (0 for an empty one)."""
    out = np.zeros((2, len(first) - 1), dtype=U)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[0, some] = np.add.reduceat(mix(hashed), first[some])
        out[1, some] = np.bitwise_xor.reduceat(mix(hashed ^ U(0x2545F4914F6CDD1D)), first[some])
    return out[0].view(np.int64), out[1].view(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the documents' offsets in them."""
    starts, ends, first = words(data, offsets)
    owner, hashed = shingles(span_hashes(data, starts, ends), first)
    return distinct_sets(owner, hashed, len(offsets) - 1)


def circulant_table(size_bits: int, k: int, seed: int = 17) -> np.ndarray:
    """A permutation of 2**size_bits values followed by its first ``k``: row i is the view [i, i+k)."""
    table = np.random.default_rng(seed).permutation(1 << size_bits).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:k]]), k)


def circulant_signatures(hashed: np.ndarray, first: np.ndarray, table: np.ndarray, block: int = 8192) -> np.ndarray:
    """Signatures of ``table.shape[1]`` coordinates for each non-empty set (empty ones: the maximum).

    The first permutation is the mixer's leading bits, an index into the second one; coordinate k is
    the least value found when the second one is shifted by k.
    """
    bits = (table.shape[0] - 1).bit_length() - 1
    at = (mix(hashed ^ U(0x5851F42D4C957F2D)) >> U(64 - bits)).astype(np.int64)
    out = np.full((len(first) - 1, table.shape[1]), np.iinfo(np.uint32).max, dtype=np.uint32)
    for lo in range(0, len(at), block):
        hi = min(len(at), lo + block)
        a, b = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, hi, side="left")
        docs = np.arange(a, b)
        docs = docs[first[docs + 1] > np.maximum(first[docs], lo)]
        cuts = np.maximum(first[docs], lo) - lo
        out[docs] = np.minimum(out[docs], np.minimum.reduceat(table[at[lo:hi]], cuts, axis=0))
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) of signed 64-bit keys; each holds its band's number."""
    out = np.empty((len(signatures), bands), dtype=U)
    for j in range(bands):
        total = np.full(len(signatures), (j + 1) * 0x9E3779B97F4A7C15 % (1 << 64), dtype=U)
        for i in range(rows):
            total = mix(total ^ signatures[:, j * rows + i].astype(U))
        out[:, j] = total
    return out.view(np.int64)
