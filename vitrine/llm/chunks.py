"""Token ids of whole texts through a memo of their space-separated chunks.

The byte-level pattern of these vocabularies never lets a token reach across the start of a single space that is
followed by a visible character, nor across a single line end between visible characters.  A text whose white space
consists of such single characters can therefore be cut there, and each distinct chunk needs to be encoded once per
worker.  Texts with any other white space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in each half of a worker's memo (about 170 bytes each), and the longest chunk that is kept.
MEMO_ENTRIES, MEMO_CHARS = 800_000, 64

#: Bytes of texts that are encoded at once.
SLICE_BYTES = 4_000_000

#: The id of a line end in both byte-level vocabularies of the 50k family, for which the cuts above hold.
LINE_END = 198

#: ASCII marks but the apostrophe: at the end of a chunk, after a letter or number, they are tokens of their own.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def chunked(texts: pa.Array) -> pa.Array:
    """The lists of chunks of ``texts`` (large_string) after a line end has been set before each: a chunk starting with a
    line end is the first of its line, any other has a space before it that isn't part of the chunk."""
    line_end, nothing = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
    return pc.split_pattern(pc.binary_join_element_wise(line_end, pc.replace_substring(texts, "\n", " \n"), nothing), " ")


def is_safe(chunk: str) -> bool:
    """Whether the cuts on both sides of the chunk are token boundaries whatever its neighbours are."""
    visible = chunk[1:] if chunk[:1] == "\n" else chunk
    return bool(visible) and not visible[0].isspace() and not visible[-1].isspace()


class ChunkEncoder:
    """Encodes batches of texts to little-endian unsigned 32-bit ids.

    ``encode_parts(chunks with the space or line end before them)`` must return all their ids as one array and where each
    chunk's begin; ``encode_text`` encodes one whole text.  The memo has two halves: when the newer one is full it becomes
    the older one, and a chunk that is met again moves to the newer one, so that frequent chunks stay.
    """

    def __init__(self, encode_parts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_text: Callable[[str], np.ndarray], entries: int = MEMO_ENTRIES):
        self.encode_parts, self.encode_text, self.entries = encode_parts, encode_text, entries
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return np.asarray(self.encode_text(text), dtype="<u4").tobytes()

    def _learn(self, chunks: Iterable[str]) -> list[str]:
        """Put the ids of ``chunks`` into the memo, none for those that can't be cut safely; returns those too long to stay."""
        ended, wanted, unsafe = [], {}, []
        for chunk in chunks:
            body = chunk[1:] if chunk[:1] == "\n" else chunk
            if not (body.isprintable() and body) and not is_safe(chunk):  # nothing printable is white space here
                self.memo[chunk] = b""
                unsafe.append(chunk)
                continue
            core = chunk.rstrip(MARKS)
            if core != chunk and core[-1:].isalnum():
                ended.append((chunk, core, chunk[len(core) :]))
                if core in self.memo:
                    continue
                if core in self.older:
                    self.memo[core] = self.older[core]
                    continue
                chunk = core
            wanted[chunk] = None
        for opening in ("\n", " "):
            some = [c for c in wanted if (c[0] == "\n") == (opening == "\n")]
            if some:
                ids, starts = self.encode_parts(some if opening == "\n" else [" " + c for c in some])
                if len(starts) != len(some):
                    raise ValueError("the encoder's ids don't match its input")
                raw = np.asarray(ids, dtype="<u4").tobytes()
                bounds = (np.append(starts, len(ids)) * 4).tolist()
                self.memo.update(zip(some, map(raw.__getitem__, map(slice, bounds, bounds[1:]))))
        for chunk, core, marks in ended:
            if marks not in self.marks:
                self.marks[marks] = self._raw(marks)
            self.memo[chunk] = self.memo[core] + self.marks[marks]
        return [c for c in {**wanted, **dict.fromkeys(x for x, _, _ in ended), **dict.fromkeys(unsafe)} if len(c) > MEMO_CHARS]

    def _ids(self, distinct: list[str]) -> list[bytes]:
        """The ids of different chunks, none for those that can't be cut safely."""
        if len(self.memo) > self.entries:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        found = list(map(memo.get, distinct))
        missing = [c for c, ids in zip(distinct, found) if ids is None]
        before = list(map(older.get, missing))
        memo.update((c, ids) for c, ids in zip(missing, before) if ids is not None)
        long = self._learn(c for c, ids in zip(missing, before) if ids is None)
        found = [memo[c] if ids is None else ids for c, ids in zip(distinct, found)]
        for chunk in long:
            del memo[chunk]
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as bytes.  Each different chunk of these texts is looked up once."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        cut = chunked(texts)
        coded = cut.flatten().dictionary_encode()
        together = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        known = self._ids(pc.binary_join(together, pa.scalar(" ", texts.type))[0].as_py().split(" "))
        place = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), dtype="<u4")
        each = sizes[place]
        ends = np.cumsum(each)
        raw = ids[np.arange(each.sum()) + np.repeat((np.cumsum(sizes) - sizes)[place] - (ends - each), each)].tobytes()
        firsts = np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))])
        bounds = (np.concatenate([[0], ends])[firsts] * 4).tolist()
        out = [raw[a + 4 : b] for a, b in zip(bounds, bounds[1:])]  # without the line end set before the text
        for i in np.unique(np.searchsorted(firsts, np.flatnonzero(each == 0), side="right") - 1).tolist():
            out[i] = self._raw(texts[i].as_py())
        return out


def ranges(sizes: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` of the sizes' sum, at least one text each."""
    start = end = total = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def slices(texts: list[str], chars: int = 500_000) -> Iterable[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters, at least one text each."""
    return ranges(map(len, texts), chars)


def pieces(texts: pa.Array, size: int = SLICE_BYTES) -> Iterable[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes, at least one text each."""
    return ranges(pc.binary_length(texts).to_pylist(), size)


_LOADED: dict[str, ChunkEncoder] = {}
_SIZES: dict[str, int] = {}


def library_encoder(path: str) -> ChunkEncoder:
    """A ChunkEncoder over the tokenizers library and the vocabulary file at ``path``, one per worker process."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def encode_text(text: str) -> np.ndarray:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

        names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        opens = np.array([n[:1] in ("Ġ", "Ċ") for n in names])  # a space or a line end

        def encode_parts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            blocks = ["".join(parts[i : i + 400]) for i in range(0, len(parts), 400)]
            done = tokenizer.encode_batch_fast(blocks, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in done])
            return ids, np.flatnonzero(opens[ids])  # a part has one space or line end, at its start

        _SIZES[path] = tokenizer.get_vocab_size()
        _LOADED[path] = ChunkEncoder(encode_parts, encode_text)
    return _LOADED[path]


def vocabulary_size(path: str) -> int:
    """Number of ids of the vocabulary file at ``path``."""
    library_encoder(path)
    return _SIZES[path]
