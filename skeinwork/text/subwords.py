"""Subword tokens for embedding models: a normaliser, WordPiece and byte-level pair merging, given a vocabulary.

Ids of a text are framed by the class and separator tokens, cut to a length, and padded to it. Vocabularies
are parameters; none is trained or bundled. Words are encoded once a process.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = " \t\n\r"
_PUNCTUATED = re.compile(r"[!-/:-@\[-`{-~]|[^ \t\n\r!-/:-@\[-`{-~]+").findall
_SPACED = re.compile(r"[^ \t\n\r]+").findall
_IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


@dataclass(frozen=True)
class Frame:
    """Ids of the special tokens."""

    cls: int
    sep: int
    pad: int
    unk: int


@dataclass
class Normalizer:
    """Cleaning of control characters, blanks round ideographs, lower case, and loss of accents, as asked for."""

    clean: bool = True
    ideographs: bool = True
    lower: bool = True
    accents: bool = False  # whether accents stay

    def __call__(self, text: str) -> str:
        if self.clean:
            text = "".join(" " if c in _BLANK or unicodedata.category(c) == "Zs" else c for c in text if c in "\t\n\r" or not (unicodedata.category(c) == "Cc" or c == "�"))
        if self.ideographs:
            text = "".join(f" {c} " if any(a <= ord(c) <= b for a, b in _IDEOGRAPHS) else c for c in text)
        if self.lower:
            text = text.lower()
        return text if self.accents else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def words(text: str, by: str = "punctuation") -> list[str]:
    """Words of a text: cut at blanks and single signs ("punctuation"), at blanks ("whitespace"), or not at all ("none")."""
    if by == "none":
        return [text] if text else []
    return (_PUNCTUATED if by == "punctuation" else _SPACED)(text)


@dataclass
class Subwords:
    """What both kinds share: normal form, words, frame, cut and padding."""

    vocab: dict[str, int]
    frame: Frame
    normalizer: Normalizer = field(default_factory=Normalizer)
    by: str = "punctuation"

    def __post_init__(self) -> None:
        self.known = lru_cache(100_000)(self.word)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def word(self, word: str) -> tuple[int, ...]:
        raise NotImplementedError

    def pieces(self, found: list[str]) -> list[int]:
        return [i for w in found for i in self.known(w)]

    def encode(self, text: str | None, length: int) -> list[int]:
        """Exactly ``length`` ids (none for 0): class, content, separator, padding; a null text is empty."""
        if length <= 0:
            return []
        content = self.pieces(words(self.normalizer(text or ""), self.by))[: max(length - 2, 0)]
        ids = [self.frame.cls, *content, *([self.frame.sep] if length > 1 else [])]
        return ids + [self.frame.pad] * (length - len(ids))

    def mask(self, ids: list[int]) -> list[int]:
        """1 where an id is no padding."""
        return [int(i != self.frame.pad) for i in ids]

    def column(self, text: Column, length: int) -> Column:
        """The ids of a text column, in Arrow batches."""
        encoder = self

        @F.pandas_udf("array<bigint>")
        def run(texts):
            return texts.map(lambda t: encoder.encode(t, length))

        return run(text)


@dataclass
class WordPiece(Subwords):
    """The longest piece first; pieces inside a word have a prefix; a word with a gap is unknown as a whole."""

    prefix: str = "##"

    def word(self, word: str) -> tuple[int, ...]:
        out, at = [], 0
        while at < len(word):
            mark = self.prefix if at else ""
            end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in self.vocab), None)
            if end is None:
                return (self.frame.unk,)
            out.append(self.vocab[mark + word[at:end]])
            at = end
        return tuple(out)


def _letters() -> list[str]:
    """A printable character for every byte: itself where it is one, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_LETTERS = _letters()


@dataclass
class BytePairs(Subwords):
    """Bytes as letters, merged pair by pair in the order of ``merges``; words after the first begin with a blank."""

    merges: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.rank = {tuple(m.split(" ")): k for k, m in enumerate(self.merges)}

    def pieces(self, found: list[str]) -> list[int]:
        return [i for k, w in enumerate(found) for i in self.known(" " + w if k else w)]

    def word(self, word: str) -> tuple[int, ...]:
        symbols = [_LETTERS[b] for b in word.encode()]
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            merged, i = [], 0
            while i < len(symbols):
                both = tuple(symbols[i : i + 2]) == best
                merged.append("".join(best) if both else symbols[i])
                i += 1 + both
            symbols = merged
        return tuple(self.vocab.get(s, self.frame.unk) for s in symbols)
