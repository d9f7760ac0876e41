"""Operator 3: SentencePiece encoding and decoding for merge-type vocabularies.

Symbols of a segment form adjacent pairs on an agenda ordered by the score of the piece they would
make, then by position; the best pair merges, its neighbours are queued, outdated entries are skipped.
A short segment's agenda is a plain list searched for its best entry, a long one's a heap. Characters
outside the vocabulary become byte pieces. Texts are first cut between characters that stand side by
side in no piece (before a word mark, around a line break, before most signs): no merge can reach
across. A segment is encoded once per process.
Every new segment is checked against the sentencepiece library in the Arrow batch that brings it,
and one whole text of every slice; should they differ, the library's ids are used.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import documents, tune
from ._tokens import SegmentTable, code_points, sums, text_slices
from .word_bpe import tokenizer_path

_MARK, _REST, _LONG = 1, 128, 48
_CLASS = np.full(0x110000, _REST, dtype=np.uint8)  # ASCII by itself, the word mark as 1, all else as one
_CLASS[:128] = np.where(np.arange(128) == _MARK, _REST, np.arange(128))
_CLASS[0x2581] = _MARK


class PieceBpe:
    """Encoder and decoder of one merge-type sentencepiece model with an identity normaliser."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        names = lib.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.scores = {names[i]: -lib.get_score(i) for i in plain}
        self.id_of = {names[i]: i for i in plain}
        self.meet = np.zeros((129, 129), dtype=bool)
        self.meet[_REST, _REST] = True
        for i in plain:
            kinds = _CLASS[code_points(names[i])]
            self.meet[kinds[:-1], kinds[1:]] = True
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelled = [b"" if lib.is_control(i) else bytes([int(names[i][3:5], 16)]) if lib.is_byte(i) else " ⁇ ".encode() if lib.is_unknown(i) else names[i].replace("▁", " ").encode() for i in range(n)]
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.differing = 0
        self.table = SegmentTable(self._encode_new, 1 << 20)

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment by a score-ordered agenda of adjacent symbol pairs."""
        ids, out = self.id_of, []
        for s in self._merged_short(segment) if len(segment) <= _LONG else self._merged_long(segment):
            if (got := ids.get(s)) is not None:
                out.append(got)
            else:
                out.extend(self.bytes[b] for b in s.encode())
        return out

    def _merged_short(self, segment: str) -> list[str]:
        symbols, none, get = list(segment), math.inf, self.scores.get
        costs = [get(a + b, none) for a, b in pairwise(segment)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            symbols[i : i + 2] = [made := symbols[i] + symbols[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(made + symbols[i + 1], none)
            if i:
                costs[i - 1] = get(symbols[i - 1] + made, none)
        return symbols

    def _merged_long(self, segment: str) -> list[str]:
        scores, symbols = self.scores, list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(scores[made], i, i + 1, made) for i in range(n - 1) if (made := segment[i : i + 2]) in scores]
        heapq.heapify(queue)
        while queue:
            _, i, j, made = heapq.heappop(queue)
            if after[i] != j or not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(made):
                continue
            symbols[i], symbols[j] = made, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (more := made + symbols[k]) in scores:
                    heapq.heappush(queue, (scores[more], i, k, more))
            if (h := before[i]) >= 0 and (more := symbols[h] + made) in scores:
                heapq.heappush(queue, (scores[more], h, i, more))
        return [s for s in symbols if s]

    def _encode_new(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.agenda(x) for x in segments]
        theirs = self.library.encode([x[1:] if x[0] == "▁" else "\n" + x for x in segments], num_threads=1)  # it adds a mark
        for i, x in enumerate(segments):
            want = ids[i] if x == "▁" else theirs[i] if x[0] == "▁" else theirs[i][2:]
            if want != ids[i]:
                self.differing += 1
                ids[i] = want
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
        return np.fromiter((y for x in ids for y in x), dtype=np.uint32, count=int(offsets[-1])), offsets

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids without begin and end."""
        for _, group in text_slices(texts):
            marked = ["▁" + x.replace(" ", "▁") if x else "" for x in group]
            first = np.r_[0, np.cumsum([len(x) for x in marked])]
            text = "".join(marked)
            codes = code_points(text)
            kinds = _CLASS[codes]
            start = np.zeros(len(codes) + 1, dtype=bool)
            start[1:-1] = ~self.meet[kinds[:-1], kinds[1:]]
            start[first] = True
            starts = np.flatnonzero(start[:-1])
            rows, strange = self.table.rows(codes, starts, np.r_[starts[1:], len(codes)][: len(starts)], text)
            ids = self.table.ids(rows)
            cuts = np.searchsorted(starts, first)
            at = np.r_[0, np.cumsum(self.table.lengths(rows))][cuts]
            whole = sums(strange, cuts) > 0  # a segment shares its hash with another one: the library's ids
            sure = whole[0] or self.library.encode(group[0], num_threads=1) == ids[at[0] : at[1]].tolist()
            self.differing += not sure
            for i, x in enumerate(group):
                yield ids[at[i] : at[i + 1]] if sure and not whole[i] else np.array(self.library.encode(x, num_threads=1), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library's decode gives it: pieces joined, the first mark dropped."""
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_shared: dict[str, PieceBpe] = {}


def piece_codes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Ids include begin and end. A null or empty text has just those two and decodes to an empty text.
    A null id stays null; repeated rows give repeated results; very long texts are read whole; of equally good
    pairs the leftmost merges first, as in the library. An empty table gives an empty result; other columns
    are ignored, whatever their names. One narrow pass, no shuffle.
    """

    def run(batches):
        path = tokenizer_path(model)
        bpe = _shared.setdefault(path, None) or PieceBpe(path)
        _shared[path] = bpe
        ends = np.array([bpe.bos], dtype="<u4"), np.array([bpe.eos], dtype="<u4")
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                full = np.concatenate([ends[0], ids, ends[1]]).astype("<u4")
                n.append(len(full))
                of_ids.append(hashlib.sha256(full.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(full).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(df.sparkSession)
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes(documents(spark, sf_dir))
