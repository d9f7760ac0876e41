"""Word-level BPE of a tokenizers JSON file by rank-synchronous merging of ragged numpy arrays.

A batch of distinct pre-tokens lies in one flat array of symbols. In each round every pre-token finds
the lowest rank among its adjacent pairs and merges all its occurrences of that pair, from the left,
at once; pre-tokens without a known pair retire. The symbols that survive are the tokens.

Texts of letters and signs whose normal form, case and class don't depend on a Unicode version are
cut by tables over code points; any other text, texts that hold a special token's string, and texts
with a pre-token that shares its hash with another one go whole to the tokenizers library, so that the result is always the library's own.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from ._kernels import U, mix
from ._tokens import HashIndex, SegmentTable, code_points, sums, text_slices

_NONE = np.iinfo(np.int64).max
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _stable(c: str) -> bool:
    """Whether a character is normalised, lowered and classed alike by every library."""
    o = ord(c)
    if not (0x20 <= o < 0x7F or 0xA1 <= o < 0x530 or 0x2010 <= o < 0x2028 or 0x20A0 <= o < 0x20AD or 0x3041 <= o < 0x3097 or 0x30A1 <= o < 0x30FB or 0x4E00 <= o < 0x9FA6):
        return False
    kind = unicodedata.category(c)
    return (
        kind[0] in "LNPS" and kind not in ("Lt", "Nl") and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", "a" + c) == "a" + c
        and len(c.lower()) == 1 and c not in "ΣςİıſẞȺȾ" and unicodedata.category(c.lower())[0] == kind[0] and (c.lower() == c or c.lower().lower() == c.lower())
    )


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class and its lower case."""
    kinds, lower = np.full(0x110000, _ODD, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    for c in map(chr, range(0x21, 0x9FA6)):
        if _stable(c):
            kinds[ord(c)] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)
            lower[ord(c)] = ord(c.lower())
    return kinds, lower


class WordBpe:
    """Tokens of texts as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != "</w>":
            raise ValueError("not a lower-casing word BPE file")
        self.path, self.special = path, [x["content"] for x in spec["added_tokens"]]
        vocab = model["vocab"]
        chars = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None for b in range(256)]
        extra = iter(range(256, 512))
        chars = [c if c is not None else chr(next(extra)) for c in chars]
        self.base = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.base_end = np.array([vocab[c + "</w>"] for c in chars], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.pairs = HashIndex(18)
        self.pairs.insert(mix(keys.astype(U)), np.arange(len(keys), dtype=np.int32))
        self.kinds, self.lower = _tables()
        self.table = SegmentTable(self.merge)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def cut(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of lower-cased texts, and which texts the tables can't cut."""
        kinds, n = self.kinds[codes], len(codes)
        begins = np.zeros(n + 1, dtype=bool)
        begins[first[:-1]] = True
        start = np.empty(n + 1, dtype=bool)
        start[0], start[n] = True, True
        start[1:n] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
        start |= begins
        start[:n] &= kinds != _SPACE
        more = np.r_[codes, np.zeros(3, dtype=codes.dtype)]
        owner_end = np.r_[np.repeat(first[1:], np.diff(first)), np.zeros(3, dtype=first.dtype)]
        marks = np.flatnonzero((codes == 39) & start[:n])
        one, two, room = more[marks + 1], more[marks + 2], owner_end[marks] - marks
        short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for found, size in ((marks[short], 2), (marks[long], 3)):
            start[found + 1] = False
            rest = found + size
            rest = rest[rest < owner_end[found]]
            start[rest[kinds[rest] == _LETTER]] = True
        space_next = np.r_[kinds[1:] == _SPACE, True]
        ends = np.flatnonzero((kinds != _SPACE) & (start[1:] | space_next)) + 1
        odd = sums(kinds == _ODD, first) > 0
        return np.flatnonzero(start[:n]), ends, odd

    def merge(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the pre-tokens: rank-synchronous merging in ragged arrays."""
        raw = [x.encode() for x in pre_tokens]
        n = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(n)
        symbols = self.base[data]
        symbols[ends[n > 0] - 1] = self.base_end[data[ends[n > 0] - 1]]
        owner = np.repeat(np.arange(len(raw)), n)
        done_owner, done = [], []
        while len(symbols):
            ranks = np.full(len(symbols), _NONE)
            same = owner[:-1] == owner[1:]
            found = self.pairs.find(mix((symbols[:-1] * self.size + symbols[1:]).astype(U)))
            known = same & (found >= 0)
            ranks[:-1][known] = found[known]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[first, len(owner)])
            least = np.minimum.reduceat(ranks, first)
            retire = np.repeat(least == _NONE, length)
            done_owner.append(owner[retire])
            done.append(symbols[retire])
            if retire.all():
                break
            hit = (ranks == np.repeat(least, length)) & ~retire
            where = np.flatnonzero(hit)
            run = np.r_[True, where[1:] != where[:-1] + 1]  # in x x x only every other pair merges, from the left
            start = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - start) % 2 == 0]
            symbols[where] = self.made[ranks[where]]
            keep = ~retire
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, dtype=np.int64)
        symbols = np.concatenate(done) if done else np.zeros(0, dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.searchsorted(owner[order], np.arange(len(raw) + 1))

    def _slices(self, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """Texts, rows of all their segments, the texts' offsets in those, and which ones the library must do."""
        for _, group in text_slices(texts):
            first = np.r_[0, np.cumsum([len(x) for x in group])]
            codes = self.lower[code_points("".join(group))]
            starts, ends, odd = self.cut(codes, first)
            odd |= np.array(["<|" in x and any(y in x for y in self.special) for x in group])
            rows, strange = self.table.rows(codes, starts, ends, codes.astype("<u4").tobytes().decode("utf-32-le"))
            at = np.searchsorted(starts, first)
            odd |= sums(strange, at) > 0
            yield group, rows, at, odd

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Numbers of tokens."""
        out = []
        for group, rows, first, odd in self._slices(texts):
            n = sums(self.table.lengths(rows), first)
            for i in np.flatnonzero(odd):
                n[i] = len(self.library.encode(group[i], add_special_tokens=False).ids)
            out.append(n)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids as unsigned 32-bit integers."""
        for group, rows, first, odd in self._slices(texts):
            ids, at = self.table.ids(rows), np.r_[0, np.cumsum(self.table.lengths(rows))][first]
            for i in range(len(group)):
                yield np.array(self.library.encode(group[i], add_special_tokens=False).ids, dtype=np.uint32) if odd[i] else ids[at[i] : at[i + 1]]


_shared: dict[str, WordBpe] = {}


def shared(path: str) -> WordBpe:
    """One per process: Python workers are used again for many tasks."""
    if path not in _shared:
        _shared[sys.intern(path)] = WordBpe(path)
    return _shared[path]
