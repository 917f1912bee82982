"""Operator 10: byte-level BPE encoding and decoding by backtracking over longest matches.

A rank file gives each byte string its rank.  Bytes are mapped to Latin-1 characters, so that one pyahocorasick
automaton finds in one pass the longest vocabulary entry that starts at each byte of a pre-token.  The encoder then goes
from left to right: it takes the longest entry, steps to shorter ones, and goes back one token where none fits.  A token
fits after another if merging would have left exactly this pair; that test is memoised by pair.  Positions that once
failed are marked and not tried again, so the work is linear in the pre-token's length, and the ids are those that the
merges themselves would give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import chunks
from vitrine.llm.common import whole_text

#: Entries of a worker's memo of pair tests before it starts anew, and chunks in each half of its memo of chunks.
PAIR_ENTRIES, MEMO_ENTRIES = 500_000, 250_000


class RankEncoder:
    """Encoder and decoder for one rank file and one pre-tokenizing pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        tokens = {int(rank): base64.b64decode(word) for word, rank in pairs}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.rank = {word.decode("latin-1"): rank for rank, word in tokens.items()}
        self.split = regex.compile(pattern).findall
        self.length = [len(t) for t in self.tokens]
        self.joined: dict[int, int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.fits: dict[int, bool] = {}
        # The longest proper prefix of each entry that is an entry itself, or -1.
        self.shorter = [-1] * len(self.tokens)
        self.finder = ahocorasick.Automaton()
        for rank in sorted(tokens):
            word = tokens[rank].decode("latin-1")
            self.finder.add_word(word, (rank, len(word)))
            self._decompose(rank, word)
        self.finder.make_automaton()
        self.fits.clear()
        for word, rank in self.rank.items():
            for end in range(len(word) - 1, 0, -1):
                if (prefix := self.rank.get(word[:end])) is not None:
                    self.shorter[rank] = prefix
                    break

    def _decompose(self, rank: int, word: str) -> None:
        """Find the two earlier entries whose merge makes this one: the only pair that stays apart until then."""
        for cut in range(1, len(word)):
            left, right = self.rank.get(word[:cut]), self.rank.get(word[cut:])
            if left is not None and right is not None and max(left, right) < rank and self._stays(left, right):
                self.joined[left << 20 | right] = rank
                self.halves[rank] = (left, right)
                return

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` as neighbours.

        Undoes the merges of both, latest first; at each step the two pieces that touch must not have a merge that
        would have come before the merges undone so far.
        """
        bound = len(self.tokens) + 1
        while True:
            merged = self.joined.get(left << 20 | right)
            if merged is not None and merged < bound:
                return False
            if left > right and self.halves[left][0] != left:
                bound, left = left, self.halves[left][1]
            elif self.halves[right][0] != right:
                bound, right = right + 1, self.halves[right][0]
            elif self.halves[left][0] != left:
                bound, left = left, self.halves[left][1]
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIR_ENTRIES:
                self.fits.clear()
            known = self.fits[key] = self._stays(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 characters of its UTF-8 bytes."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for last, (rank, size) in self.finder.iter(piece):
            longest[last - size + 1] = rank  # matches come by their end, so the last one is the longest
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if open_at[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.length[token]
                # the token itself led nowhere: its end is closed now, so the loop goes on with shorter ones
        return out

    def encode_text(self, text: str) -> list[int]:
        """Ids of a text: each match of the pattern separately."""
        out: list[int] = []
        for piece in self.split(text):
            out += self.encode_piece(piece.encode("utf-8").decode("latin-1"))
        return out

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts end to end, and where each text's begin."""
        out: list[int] = []
        starts: list[int] = []
        for part in parts:
            starts.append(len(out))
            out += self.encode_text(part)
        return np.array(out, dtype="<u4"), np.array(starts, dtype=np.int64)


_LOADED: dict[tuple[str, str], tuple[RankEncoder, chunks.ChunkEncoder, pa.Array]] = {}


def loaded(path: str, pattern: str) -> tuple[RankEncoder, chunks.ChunkEncoder, pa.Array]:
    """The encoder, its memo and the table of token bytes; one of each per worker process."""
    key = (path, pattern)
    if key not in _LOADED:
        encoder = RankEncoder(path, pattern)
        line_end = encoder.rank.get("\n")
        memo = chunks.ChunkEncoder(encoder.encode_parts, encoder.encode_text, MEMO_ENTRIES)
        if line_end != chunks.LINE_END:  # another vocabulary: no cutting at white space
            memo.encode = lambda texts: [np.array(encoder.encode_text(t), dtype="<u4").tobytes() for t in texts]
        _LOADED[key] = encoder, memo, pa.array(encoder.tokens, pa.large_binary())
    return _LOADED[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: (id, ids array<int>), one row for each input row.

    A null text is the empty text and has no ids; equal or repeated rows are encoded alike; a null id stays null; other
    columns are not carried.  ``path`` names the rank file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo, _ = loaded(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks.slices(texts):
                parts = memo.encode(texts[a:b])
                ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    kept = docs.select(F.col(id_col), whole_text(text_col).alias("__text"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids: (id, ids, decoded binary).  Null ids decode to no bytes; an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, words = loaded(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if len(flat) and (flat.to_numpy().min() < 0 or flat.to_numpy().max() >= len(words)):
                raise ValueError("an id is outside the vocabulary")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            found = words.take(flat)
            starts = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1, offset=found.offset * 8)
            body = found.buffers()[2] or pa.py_buffer(b"")
            offsets = (starts[bounds.astype(np.int64)]).astype(np.int64)
            decoded = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), body])
            yield pa.record_batch([batch.column(0), lists, decoded.cast(pa.binary())], names=[id_col, ids_col, "decoded"])

    kept = encoded.select(id_col, ids_col)
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, `{ids_col}` array<int>, decoded binary")
