"""Operator 2: language-model scores from a probabilistic suffix tree over words.

The tree's nodes are contexts of up to ``depth`` words.  A context is kept if the distribution of what follows it diverges
enough from that of its suffix: its gain in log likelihood must exceed the cost of its entries.  Distributions are
smoothed by absolute discounting: an entry keeps its count less a discount, and what is left goes to the suffix's
distribution, down to the root's add-one estimate.  A token is scored in the state of the longest kept suffix of the
words before it.

All counts cover the whole training corpus; what the tree holds grows with it, and no task or driver ever holds the tree.
Texts are tokenised once, into chunks.  For each length of sequences in turn, every chunk asks for the counts of its
different sequences: the questions go to buckets by hash, where they are added up, and the answers come back to the
chunks.  A sequence is only asked about if both sequences one word shorter were frequent.  One of the chunks that hold a
frequent sequence adds it to the sums of its context; the contexts that pass the test answer once more.  So each token
ends with the probability that the whole tree gives it.  Words and sequences are known by hashes of 64 bits,
of which 48 travel within a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bucketed, dropped, shuffle_width, whole_text, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: The end token's hash, random numbers for bytes (none for white space), and the base of their powers.
END = np.int64(0x1F83D9ABFB41BD6B)
_CODES = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[[9, 10, 11, 12, 13, 32]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Characters of a chunk, and tokens for each bucket of questions.
CHUNK_CHARS, BUCKET_TOKENS = 3_000_000, 2_000_000

#: Bytes of text that are tokenised at once, if they aren't one text.
SEGMENT = 1 << 18

#: Steps of a stored logarithm to a whole decade.
LOG_STEPS = 1 << 14

#: What a chunk holds beside its rows' ids, as compressed arrays: their numbers of tokens and whether they are learnt from;
#: the hashes of its different words, the most frequent first, and each token's place among them; the words' counts.
BASE = {"sizes": np.int64, "learn": np.bool_, "words": np.int64, "place": np.uint32, "freq": np.int64}

#: What is known so far of a chunk: the sum of each text's logarithms of probabilities that are final; the logarithms of the
#: other tokens' probabilities so far; the counts of the sequences that end at each
#: token, of the last length but one and of the last one; and sums for contexts.  Nothing at first: then the root gives
#: the probabilities, and sequences are words.
STATE = {
    "done": np.float64, "log": np.int32, "count": np.int64, "next": np.int64,
    "sum_key": np.int64, "sum_size": np.int64, "sum_k": np.int64, "sum_stored": np.int64, "sum_gain": np.float32, "sum_mass": np.float32,
}

#: What a chunk asks: how often sequences occur, and the weights of contexts.
ENTRIES, CONTEXTS = 0, 1


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token of the texts end to end, number of tokens of each): words in lower case (A-Z), then the end
    token.  A word's hash is a sum over its bytes of a random number for the byte times a power for its place."""
    found, held, size = [], [], 0
    for i, text in enumerate(texts, 1):
        held.append(text.encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= SEGMENT or i == len(texts):
            found.append(_segment_hashes(held))
            held, size = [], 0
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _segment_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((b" ".join(encoded) + b" ").translate(_LOWER), dtype=np.uint8)
    codes = _CODES[data]
    visible = np.append(False, codes != 0)
    starts = np.flatnonzero(visible[1:] & ~visible[:-1])
    sums = np.zeros(0, dtype=np.int64)
    if len(starts):
        sizes = np.diff(np.append(starts, len(data)))  # with the white space after a word, which counts for nothing
        powers = np.full(int(sizes.max()), _BASE)
        powers[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(powers, out=powers)
            place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
            h = np.add.reduceat(codes[starts[0] :] * powers[place], starts - starts[0])
            h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            sums = (h ^ h >> np.uint64(29)).view(np.int64)
    counts = np.searchsorted(starts, np.cumsum([len(e) + 1 for e in encoded]))
    return np.insert(sums, counts, END), np.diff(np.append(0, counts)) + 1


def joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of all but the last word and that of the last word."""
    with np.errstate(over="ignore"):
        h = before.view(np.uint64) * np.uint64(0x9E3779B185EBCA87) + after.view(np.uint64)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0x165667B19E3779F9)
        return (h ^ h >> np.uint64(29)).view(np.int64)


def packed(array, kind: type) -> bytes:
    """An array of a type, compressed; no bytes for an empty one.  Integers from 0 take the smallest type that holds them."""
    raw = np.ascontiguousarray(array, kind)
    if not len(raw):
        return b""
    if raw.dtype.kind == "i" and raw.min() >= 0 or raw.dtype.kind == "u":
        raw = raw.astype(np.min_scalar_type(int(raw.max())))
    flat, planes = raw.view(np.uint8), np.empty((raw.itemsize, len(raw)), dtype=np.uint8)
    for i in range(raw.itemsize):  # bytes of one weight lie together; plane by plane, as a transposed copy is many times slower
        planes[i] = flat[i :: raw.itemsize]
    return raw.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes.data)


def unpacked(blob: bytes | None, kind: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=kind)
    found = np.dtype(blob[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[1:]), dtype=np.uint8).reshape(found.itemsize, -1)
    flat = np.empty(planes.size, dtype=np.uint8)
    for i in range(found.itemsize):
        flat[i :: found.itemsize] = planes[i]
    return flat.view(found).astype(kind, copy=False)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the different keys in order, where one of each is, each key's place among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    to = np.empty(len(keys), dtype=np.int64)
    to[order] = np.cumsum(new) - 1
    return ordered[new], order[new], to


class Chunk:
    """One chunk's arrays, unpacked when they are asked for, and what they say about sequences of words."""

    def __init__(self, row: dict, least: int):
        self.made, self.least = row, least

    def __getattr__(self, name: str) -> np.ndarray:
        kind = BASE.get(name) or STATE.get(name)
        if kind is None:
            raise AttributeError(name)
        found = unpacked(self.made.get(name), kind)
        setattr(self, name, found)
        return found

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def inside(self) -> np.ndarray:
        """Each token's place in its text."""
        return np.arange(len(self.place)) - np.repeat(self.starts, self.sizes)

    @cached_property
    def token(self) -> np.ndarray:
        return self.words[self.place]

    @cached_property
    def learnt(self) -> np.ndarray:
        return np.repeat(self.learn, self.sizes)

    @cached_property
    def frequent(self) -> np.ndarray:
        """The count of each token's word; 0 where it isn't frequent."""
        return np.where(self.freq >= self.least, self.freq, 0)[self.place]

    @property
    def last(self) -> np.ndarray:
        """Counts of the sequences of the last length that end at each token; 0 of those that aren't frequent."""
        return self.next if len(self.next) else self.frequent

    @property
    def before(self) -> np.ndarray:
        """The same of the last length but one."""
        return self.count if len(self.count) else self.frequent

    def probabilities(self, scale: float, at: np.ndarray) -> np.ndarray:
        """Probabilities so far of some tokens; ``scale`` is that of the root's counts."""
        if len(self.log):
            return 10.0 ** (self.log[at] / -LOG_STEPS)
        return ((self.freq + 1) / scale)[self.place[at]]

    def sequences(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` words that end at some tokens."""
        h = self.token[at - (n - 1)]
        for back in range(n - 2, -1, -1):
            h = joined(h, self.token[at - back])
        return h

    def contexts(self, depth: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens with a frequent context of ``depth`` words, its hash, its count); ``count``: of sequences as long."""
        at = np.flatnonzero(count[:-1]) + 1
        at = at[self.inside[at] >= depth]
        return at, self.sequences(at - 1, depth), count[at - 1]

    def entries(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens whose context of ``depth`` words is frequent, and whose suffix with the token is, the hash of context
        and token, that of the context, its count)."""
        at, context, size = self.contexts(depth, self.last)
        some = self.last[at] > 0
        at, context, size = at[some], context[some], size[some]
        return at, joined(context, self.token[at]), context, size


def _rows(rows: list[dict], kinds: dict, ids_kind: pa.DataType | None = None) -> pa.Table:
    head = [("chunk", pa.int64())] if ids_kind is None else [("chunk", pa.int64()), ("tokens", pa.int64()), ("ids", ids_kind)]
    return pa.Table.from_pylist(rows, schema=pa.schema([*head, *[(n, pa.binary()) for n in kinds]]))


def _made(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """id, text, learn -> chunks."""
    ids, texts, learn, size, n = [], [], [], 0, 0
    ids_kind = None

    def close() -> Iterator[pa.RecordBatch]:
        found, sizes = word_hashes(texts)
        words, _, place = grouped(found)
        order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        row = {"chunk": TaskContext.get().partitionId() << 32 | n, "tokens": len(found), "ids": list(ids)}
        arrays = {"sizes": sizes, "learn": learn, "words": words[order], "place": back[place]}
        row |= {name: packed(arrays.get(name, ()), kind) for name, kind in BASE.items()}
        yield from _rows([row], BASE, ids_kind).to_batches()

    for batch in batches:
        ids_kind = pa.list_(batch.schema.field(0).type)
        for key, text, taught in zip(*[c.to_pylist() for c in batch.columns]):
            ids.append(key)
            texts.append(text)
            learn.append(taught)
            size += len(text)
            if size >= chars:
                yield from close()
                ids, texts, learn, size, n = [], [], [], 0, n + 1
    if ids:
        yield from close()


def _dealt(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket, and where each bucket starts and the last one ends."""
    bucket = np.mod(keys, width).astype(np.min_scalar_type(width))  # small types sort in linear time
    order = np.argsort(bucket, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(bucket, minlength=width)))


def _short(keys: np.ndarray) -> bytes:
    """The low 48 bits of keys: enough to tell those of one bucket apart.  First the low 32 of all, then the others."""
    return keys.astype("<u4").tobytes() + (keys >> 32).astype("<u2").tobytes()


def _long(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    out = np.frombuffer(blob, dtype="<u2", count=n, offset=4 * n).astype("<i8")
    out <<= 32
    out |= np.frombuffer(blob, dtype="<u4", count=n)
    return out


def _asked(chunks: DataFrame, questions: Callable[[Chunk], Iterator[tuple[int, np.ndarray, np.ndarray]]], width: int, least: int) -> DataFrame:
    """(bucket, kind, chunk, keys, counts): every chunk's different keys and how often it adds them, dealt into buckets.
    ``questions`` gives kinds, keys and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for kind, keys, counts in questions(Chunk(row, least)):
                    order, starts = _dealt(keys, width)
                    keys, counts = keys[order], counts[order]
                    spans = enumerate(zip(starts.tolist(), starts[1:].tolist()))
                    rows += [(b, kind, row["chunk"], _short(keys[a:z]), packed(counts[a:z], np.int64)) for b, (a, z) in spans if z > a]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "kind", "chunk", "keys", "counts"])

    return chunks.mapInArrow(run, "bucket int, kind int, chunk long, keys binary, counts binary")


def _answered(questions: DataFrame, weights: DataFrame, width: int, least: int) -> DataFrame:
    """(chunk, kind, bucket, answer, total, different).

    Entries: twice the summed count of every asked key, 0 below ``least``; of the chunks that asked for a key one gets 1
    more: that one speaks for it.  Contexts: the value that ``weights`` (key, value) has for every asked key, 0 where
    it has none.  ``total`` and ``different`` are set in one row of a bucket's entries.
    """

    def parts(flat: np.ndarray, keys: list[np.ndarray]) -> list[bytes]:
        ends = np.cumsum([0, *map(len, keys)]).tolist()
        return [packed(flat[a:b], flat.dtype) for a, b in zip(ends, ends[1:])]

    def entries(keys: list[np.ndarray], counts: list[bytes]) -> tuple[list[bytes], int, int]:
        _, first, to = grouped(np.concatenate(keys))
        # doubles hold counts of up to 2 to the 53rd exactly
        sums = np.bincount(to, weights=np.concatenate([unpacked(c, np.int64) for c in counts]), minlength=len(first)).astype(np.int64)
        said = 2 * np.where(sums >= least, sums, 0)
        answer = said[to]
        answer[first] += said > 0
        return parts(answer, keys), int(sums.sum()), int((sums > 0).sum())

    def contexts(keys: list[np.ndarray], known: pa.Table) -> list[bytes]:
        flat, value = np.concatenate(keys), np.zeros(sum(map(len, keys)), dtype=np.float32)
        if known.num_rows:
            have = known["key"].to_numpy() & ((1 << 48) - 1)
            order = np.argsort(have)
            have, values = have[order], known["value"].to_numpy()[order]
            at = np.minimum(np.searchsorted(have, flat), len(have) - 1)
            value = np.where(have[at] == flat, values[at], 0).astype(np.float32)
        return parts(value, keys)

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        found = []
        for kind in (ENTRIES, CONTEXTS):
            some = asked.filter(pa.compute.equal(asked["kind"], kind))
            if some.num_rows:
                keys, total, different = [_long(k) for k in some["keys"].to_pylist()], 0, 0
                if kind == ENTRIES:
                    answers, total, different = entries(keys, some["counts"].to_pylist())
                else:
                    answers = contexts(keys, known)
                none = [0] * (some.num_rows - 1)
                columns = [some["chunk"], some["kind"], some["bucket"], pa.array(answers, pa.binary()), pa.array([total, *none], pa.int64()), pa.array([different, *none], pa.int64())]
                found.append(pa.table(columns, names=["chunk", "kind", "bucket", "answer", "total", "different"]))
        kinds = [("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary()), ("total", pa.int64()), ("different", pa.int64())]
        return pa.concat_tables(found) if found else pa.schema(kinds).empty_table()

    placed = weights.withColumn("bucket", F.pmod("key", F.lit(width)).cast("int"))
    schema = "chunk long, kind int, bucket int, answer binary, total long, different long"
    return questions.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(run, schema)


def _told(chunks: DataFrame, answers: DataFrame, width: int, least: int, change: Callable[[Chunk, Callable], dict], kinds: dict, schema: str) -> DataFrame:
    """What ``change`` makes of the chunks; it gets a chunk and a function that gives the answers for keys of a kind."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            told = sorted(zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["answer"].to_pylist()))

            def said(kind: int, keys: np.ndarray) -> np.ndarray:
                dtype = np.int64 if kind == ENTRIES else np.float32
                out = np.zeros(len(keys), dtype=dtype)
                out[_dealt(keys, width)[0]] = np.concatenate([np.zeros(0, dtype), *[unpacked(x, dtype) for k, _, x in told if k == kind]])  # noqa: B023
                return out

            rows.append({"chunk": row["chunk"]} | change(Chunk(row, least), said))
        return _rows(rows, kinds, left.schema.field("ids").type if kinds is BASE else None)

    right = answers.select("chunk", "kind", "bucket", "answer")
    return chunks.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, schema)


def _ask_words(chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    yield ENTRIES, chunk.words, np.bincount(chunk.place, weights=chunk.learnt, minlength=len(chunk.words))


def _learn_words(chunk: Chunk, said: Callable) -> dict:
    """Words' counts.  Of words that aren't frequent only the count is kept: they are in no context and no entry."""
    freq = said(ENTRIES, chunk.words) // 2
    kept = freq >= chunk.least
    to = np.where(kept, np.cumsum(kept) - 1, kept.sum() + freq)
    rare = np.arange(chunk.least)
    changed = {"words": np.append(chunk.words[kept], rare), "freq": np.append(freq[kept], rare), "place": to[chunk.place]}
    return chunk.made | {name: packed(array, BASE[name]) for name, array in changed.items()}


def _ask(depth: int, most: int) -> Callable[[Chunk], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Entries of ``depth`` words of context, up to ``most``, and the weights of contexts one word shorter."""

    def asked(chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if depth <= most:
            at, keys, _, _ = chunk.entries(depth)
            different, _, to = grouped(keys)
            yield ENTRIES, different, np.bincount(to, weights=chunk.learnt[at], minlength=len(different))
        if depth > 1:
            different = np.unique(chunk.contexts(depth - 1, chunk.before)[1])
            yield CONTEXTS, different, np.zeros(len(different))

    return asked


def _learn(depth: int, most: int, scale: float, discount: float) -> Callable[[Chunk, Callable], dict]:
    """Probabilities in the contexts of ``depth`` - 1 words that are kept; then the counts of sequences one word longer,
    and for those that the chunk speaks for the sums of their contexts."""

    def weighed(chunk: Chunk, said: Callable) -> np.ndarray:
        at, context, size = chunk.contexts(depth - 1, chunk.before)
        different, _, to = grouped(context)
        backoff = said(CONTEXTS, different)[to].astype(np.float64)
        kept = backoff > 0
        at, size, backoff = at[kept], size[kept], backoff[kept]
        p = np.maximum(chunk.next[at] - discount, 0) / size + backoff * chunk.probabilities(scale, at)
        log = chunk.log / -LOG_STEPS if len(chunk.log) else np.log10((chunk.freq + 1) / scale)[chunk.place]
        log[at] = np.log10(p)
        return log

    def change(chunk: Chunk, said: Callable) -> dict:
        made: dict[str, np.ndarray] = {}
        if depth > 1:
            log = weighed(chunk, said)
            left = np.zeros(len(log), dtype=bool)  # tokens whose longer contexts are still to be looked at
            if depth <= most:
                left[chunk.contexts(depth, chunk.last)[0]] = True
            final = np.add.reduceat(np.where(left, 0.0, log), chunk.starts)
            made["done"] = final + chunk.done if len(chunk.done) else final
            chunk.log = made["log"] = np.where(left, np.rint(log * -LOG_STEPS), 0).astype(np.int32)
        if depth <= most:
            at, keys, context, size = chunk.entries(depth)
            different, first, to = grouped(keys)
            answer = said(ENTRIES, different)
            n = np.zeros(len(chunk.place), dtype=np.int64)
            n[at] = (answer // 2)[to]
            own = first[answer % 2 == 1]
            sums, where, group = grouped(context[own])
            stored, p = n[at[own]], chunk.probabilities(scale, at[own])
            gain = stored * np.log(stored / size[own] / p)
            made |= {name: np.bincount(group, weights=x, minlength=len(sums)) for name, x in (("sum_stored", stored), ("sum_gain", gain), ("sum_mass", p))}
            made |= {"count": chunk.next, "next": n, "sum_key": sums, "sum_size": size[own][where], "sum_k": np.bincount(group, minlength=len(sums))}
        return {name: packed(made.get(name, ()), kind) for name, kind in STATE.items()}

    return change


def _kept(state: DataFrame, cost: float, discount: float) -> DataFrame:
    """(key, value): contexts whose divergence pays for their entries, and the weight of their suffix's distribution."""
    names = [n for n in STATE if n.startswith("sum_")]
    kinds = [np.int64] * 4 + [np.float64] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(row[n], STATE[n]).astype(k)) for n, k in zip(names, kinds)], names=["key", "size", "k", "stored", "gain", "mass"])

    rows = state.select(*names).mapInArrow(run, "key long, size long, k long, stored long, gain double, mass double")
    found = rows.groupBy("key").agg(F.max("size").alias("size"), *[F.sum(c).alias(c) for c in ("k", "stored", "gain", "mass")])
    rest = F.col("size") - F.col("stored")
    other = F.when((rest > 0) & (F.col("mass") < 1), rest * F.log(rest / F.col("size") / (1 - F.col("mass")))).otherwise(0.0)
    passing = found.where(F.col("gain") + other >= cost * F.col("k") * F.log(F.col("size") + 1))
    return passing.select("key", ((rest + discount * F.col("k")) / F.col("size")).alias("value"))


def _scores(chunks: DataFrame, scale: float, id_type: str, id_col: str) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for i, row in enumerate(batch.to_pylist()):
                chunk = Chunk(row, 1)
                freq = chunk.freq[chunk.place]
                known, score = np.add.reduceat((freq > 0).astype(np.int64), chunk.starts), np.add.reduceat(np.log10((freq + 1) / scale), chunk.starts)
                tree = chunk.done + np.add.reduceat(chunk.log.astype(np.int64), chunk.starts) / -LOG_STEPS if len(chunk.done) else score
                sums = [known, score, tree]
                columns = [ids.slice(i, 1).flatten(), pa.array(chunk.sizes), *[pa.array(x) for x in sums]]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    return chunks.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, n_known long, base_score double, score double")


def score_texts(
    docs: DataFrame,
    learn: Column,
    depth: int = 3,
    least: int = 2,
    discount: float = 0.75,
    cost: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Score every whole text by a tree learnt from the rows where ``learn`` holds (null counts as false).

    Returns (id, n_tokens, n_known, train_tokens, base_score, score), one row for each input row; scores are log10
    probabilities, that of a token to within half a step of ``LOG_STEPS``; ``base_score`` is that of the add-one root alone
    and exact.  A null or empty text is the end token alone.  Null
    and repeated ids are scored like others.  Without training rows every probability is 1.  An empty table gives no
    rows.  Other columns are not carried.  A context and an entry need ``least`` occurrences, whatever the corpus;
    ``cost`` is what an entry costs in units of the logarithm of its context's count; ``depth`` is the longest context
    in words.  ``chunk_chars`` sets only how much text a task handles at once; no text is cut.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    id_type = dict(rows.dtypes)[id_col]
    base_schema = ", ".join(["chunk long, tokens long", f"ids array<{id_type}>", *[f"{n} binary" for n in BASE]])
    state_schema = ", ".join(["chunk long", *[f"{n} binary" for n in STATE]])
    made, made_path = bucketed(rows.mapInArrow(lambda batches: _made(batches, chunk_chars), base_schema), "chunks", "chunk", compression="none")
    volume = made.agg(F.sum("tokens")).first()[0] or 0
    width = max(shuffle_width(spark), int(volume // BUCKET_TOKENS))
    nothing = spark.createDataFrame([], "key long, value double")

    answers, used = written(_answered(_asked(made, _ask_words, width, least), nothing, width, 1), "answers")
    sums = answers.agg(F.sum("total").alias("n"), F.sum("different").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"] or 0
    scale = float(total + distinct + 1)
    base, base_path = bucketed(_told(made, answers, width, least, _learn_words, BASE, base_schema), "chunks", "chunk", placed=True, compression="none")
    dropped(spark, used, made_path)
    now, paths, kept, kept_path = base, [], nothing, None
    for d in range(1, depth + 2):
        answers, used = written(_answered(_asked(now, _ask(d, depth), width, least), kept, width, least), "answers")
        state, path = bucketed(_told(now, answers, width, least, _learn(d, depth, scale, discount), STATE, state_schema), "state", "chunk", placed=True, compression="none")
        dropped(spark, used, *paths, *([kept_path] if kept_path else []))
        now, paths = base.join(state, "chunk"), [path]
        if d <= depth:
            kept, kept_path = written(_kept(state, cost, discount), "contexts")
            if not kept.limit(1).count():
                paths.append(kept_path)
                break
    scored, _ = written(_scores(now, scale, id_type, id_col), "scores")
    dropped(spark, base_path, *paths)
    return scored.select(id_col, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
