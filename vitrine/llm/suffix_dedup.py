"""Operator 1: removal of repeated substrings through sorted suffixes.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else is removed.  Sorting the suffixes
at all positions would move hundreds of times the corpus, so only anchors are sorted: in each window of ``length`` bytes
the position whose short gram has the least hash.  The choice depends on the window alone, so equal windows have their
anchors at the same place, and every repeated window is found at its anchor.  An anchor's context reaches as far as the
windows that chose it.

* Equal texts are one class; a class of several texts is a repetition of its own.
* Anchors are counted by gram and context hash.  A gram that occurs once has no repetition; one whose contexts are all
  equal is covered by them; neither needs any bytes.
* For the other grams one copy of each different context is cut from its text.  In a gram's group the right-hand parts
  are suffixes sorted by multikey quicksort and blind tries, and so are the reversed left-hand parts.  Groups of
  suffixes with a common prefix are then merged from the longest prefix down, the smaller into the larger; the
  neighbours in left-hand order at each merge are the only pairs that can be a new longest repetition.
* Groups above a bound are dealt into smaller ones by longer parts before the sort, in a way that loses no pair.

The texts are written once as a table bucketed by class, so that later passes join them without moving them again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bucketed, dropped, shuffle_width, whole_text, written
from vitrine.llm.suffix_sort import common_prefix, sort_strings

#: Bytes of an anchor's gram, windows handled at once, and contexts that one task sorts together.
GRAM, SEGMENT, GROUP = 32, 1 << 20, 20_000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes modulo 2**64 of any part of a byte array, from sums of prefixes."""

    def __init__(self, most: int):
        self.codes = np.random.default_rng(20).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(_BASE, most + 1), _powers(pow(_BASE, -1, 1 << 64), most + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=out[1:])
        return out

    def parts(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_HASHER: list[Hasher] = []


def _hasher(length: int) -> Hasher:
    if not _HASHER or len(_HASHER[0].up) < 2 * SEGMENT + 2 * length:
        _HASHER[:] = [Hasher(2 * SEGMENT + 2 * length)]
    return _HASHER[0]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64(_MASK), dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of several texts laid end to end: (text, place, left, right, gram hash, context hash).

    The windows of an anchor lie between ``left`` bytes before it and ``right`` bytes after it.
    """
    hasher = _hasher(length)
    sums, grams = hasher.sums(data), np.arange(len(data) - gram + 1)
    hashes = hasher.parts(sums, grams, grams + gram)
    # the place in the low bits: the first of equal grams wins
    least = _sliding_least(hashes & np.uint64(_MASK ^ 0xFFFFFF) | grams.astype(np.uint64), length - gram + 1)
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    counts = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    chosen = place[window]
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(chosen))[: len(first)] - 1
    at, text = chosen[first], owner[first]
    low, high = window[first], window[last] + length
    context = hasher.parts(sums, low, high) + (at - low).astype(np.uint64)
    return text, at - starts[text], at - low, high - at, hashes[at].view(np.int64), mixed(context).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """h, g, text -> h, g, place, left, right, a, x."""

    def found(pieces: list[tuple[int, int, bytes]], batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([p[0] for p in pieces])
        shift = np.array([p[1] for p in pieces], dtype=np.int64)
        sizes = np.array([len(p[2]) for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        text, place, left, right, a, x = anchors(np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8), ends - sizes, ends, length, gram)
        owner = pa.array(rows[text])
        columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(place + shift[text])]
        columns += [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(a), pa.array(x)]
        return pa.RecordBatch.from_arrays(columns, names=["h", "g", "place", "left", "right", "a", "x"])

    for batch in batches:
        pieces, held = [], 0
        for i, text in enumerate(batch.column(2).to_pylist()):
            raw = text.encode("utf-8", "replace")
            # a long text in segments that share all but one byte of a window
            for at in range(0, max(len(raw) - length + 1, 0), SEGMENT):
                pieces.append((i, at, raw[at : at + SEGMENT + length - 1]))
                held += len(pieces[-1][2])
                if held >= SEGMENT:
                    yield found(pieces, batch)
                    pieces, held = [], 0
        if pieces:
            yield found(pieces, batch)


def repeated_parts(contexts: list[tuple[bytes, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For different contexts (left part, right part) of one gram: the parts (left, right) around the anchor that are
    also around another's and are at least ``length`` long."""
    right = [r for _, r in contexts]
    left = [l[::-1] for l, _ in contexts]
    order, shared = sort_strings(right)
    left_order, _ = sort_strings(left)
    rank = [0] * len(contexts)
    for i, item in enumerate(left_order):
        rank[item] = i
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    group = list(range(len(order)))
    members = [[rank[item]] for item in order]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for depth, at in sorted(((shared[i], i) for i in range(1, len(order))), reverse=True):
        big, small = root(at - 1), root(at)
        if len(members[big]) < len(members[small]):
            big, small = small, big
        into, rest = members[big], members[small]
        # neighbours from different sides, where the smaller side's members come to lie among the larger's
        for r in rest:
            i = bisect_left(into, r)
            for j in (i - 1, i):
                if 0 <= j < len(into):
                    one, two = left_order[r], left_order[into[j]]
                    back = common_prefix(left[one], left[two])
                    if back + depth >= length:
                        found[one].append((back, depth))
                        found[two].append((back, depth))
        for r in rest:
            insort(into, r)
        members[small] = []
        group[small] = big
    return found


def _spans(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals; touching ones are one."""
    out: list[list[int]] = []
    for start, end in sorted(pairs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _text_classes(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """Different texts as a table bucketed by (h, g): h, g, text, n; and its path."""
    text = whole_text(text_col).alias("text")
    one = docs.select(text).select(*class_key("text"), "text").groupBy("h", "g").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    return bucketed(one, "texts", "h", "g", placed=True)


def class_key(text_col: str) -> list[Column]:
    """96 bits of hash that stand for a text."""
    text = whole_text(text_col)
    return [F.xxhash64(text).alias("h"), F.shiftright(F.xxhash64(F.lit(1), text), 32).cast("int").alias("g")]


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cut contexts from texts: (a, x, n, before, after)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "replace")
                rows = [(p["a"], p["x"], p["n"], raw[p["place"] - p["left"] : p["place"]], raw[p["place"] : p["place"] + p["right"]]) for p in places]
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "x", "n", "before", "after"])

    places = wanted.groupBy("h", "g").agg(F.collect_list(F.struct("a", "x", "n", "place", "left", "right")).alias("places"))
    return texts.join(places, ["h", "g"]).select("text", "places").mapInArrow(cut, "a long, x long, n long, before binary, after binary")


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """(a, x, parts): repeated parts of contexts, group by group (column ``k``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            parts = repeated_parts([(r[3], r[4]) for r in held], length)
            out.extend((r[1], r[2], [{"l": l, "r": r} for l, r in dict.fromkeys(p)]) for r, p in zip(held, parts) if p)
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else ([], [], [])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())]))]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "x", "parts"])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][0] != row[0]:
                    close()
                held.append(row)
            if len(out) > 5000:
                yield flush()
        if held:
            close()
        yield flush()

    dealt = contexts.select("k", "a", "x", "before", "after").repartition(shuffle_width(contexts.sparkSession), "k").sortWithinPartitions("k", "x")
    return dealt.mapInArrow(run, "a long, x long, parts array<struct<l: int, r: int>>")


def _groups_to_sort(contexts: DataFrame, gram: int, length: int, group: int) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Contexts in groups (column ``k``) of at most ``group``, parts that need no sorting, and tables that both read.

    All contexts of a gram are one group at first.  Two of them that share a string of ``length`` bytes agree on some
    bytes before the anchor and some after it; in a group whose members agree on ``lo`` and ``hi`` of them, ``need``
    more are missing, and a pair that shares a string has half of these after the anchor or the rest before it.  So a
    group that is too large is dealt into smaller ones twice, by longer right-hand parts and by longer left-hand parts,
    and no pair is lost.  Where nothing is missing any more, all members share the string between.
    """
    spark, paths = contexts.sparkSession, []
    now = contexts.select(F.col("a").alias("k"), "a", "x", "before", "after", F.lit(0).alias("lo"), F.lit(gram).alias("hi"))
    ready, found = [], None
    while True:
        large, path = written(now.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > group).select("k"), "large-groups")
        paths.append(path)
        if not large.limit(1).count():
            ready.append(now)
            break
        ready.append(now.join(large, "k", "left_anti"))
        need = F.lit(length) - F.col("lo") - F.col("hi")
        half = F.ceil(need / 2).cast("int")
        hi, lo = F.col("hi") + half, F.lit(length + 1) - F.col("hi") - half
        hot = now.join(large, "k", "left_semi")
        split = hot.where(need > 0)
        right = split.where(F.octet_length("after") >= hi).withColumn("k", F.xxhash64("k", F.lit(1), F.substring("after", F.lit(1), hi))).withColumn("hi", hi)
        left = split.where(F.octet_length("before") >= lo).withColumn("k", F.xxhash64("k", F.lit(2), F.substring("before", -lo, lo))).withColumn("lo", lo)
        parts = hot.where(need == 0).select("a", "x", F.array(F.struct(F.col("lo").alias("l"), F.col("hi").alias("r"))).alias("parts"))
        done, path = written(parts, "shared-parts")
        found = done if found is None else found.unionByName(done)
        paths.append(path)
        now, path = written(right.unionByName(left), "split-groups")
        paths.append(path)
        now = now.join(now.groupBy("k").count().where("count > 1").select("k"), "k", "left_semi")
    return reduce(DataFrame.unionByName, ready), found, paths


def repeats(
    docs: DataFrame,
    columns: dict[str, Column] | None = None,
    carry: dict[str, Column] | None = None,
    whole_characters: bool = False,
    length: int = 200,
    gram: int = GRAM,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Repeated strings of ``length`` UTF-8 bytes, overlapping ones and those within one text included.

    Returns the id and ``columns``, which may use n_bytes, spans (array of [start, end) in bytes, maximal and in order)
    and kept (the bytes outside the spans, as binary); by default those three.  ``carry`` names further columns of the
    input to return.  With ``whole_characters`` kept also loses the rest of characters that a span's end cuts.  One row for
    each input row.  A null text is empty and has no spans, like any text shorter than ``length``; texts that occur in several rows are covered
    whole; ids may be null or repeated; an empty table gives no rows; other columns are not carried.
    """
    columns = columns or {c: F.col(c) for c in ("n_bytes", "spans", "kept")}
    texts, *paths = _text_classes(docs, text_col)
    schema = "h long, g int, place long, left int, right int, a long, x long"
    found = texts.where(F.octet_length("text") >= length).select("h", "g", "text")
    places, path = written(found.mapInArrow(lambda b: _anchor_rows(b, length, gram), schema), "anchors")
    paths.append(path)
    # Counts of contexts and grams, so that one join tells every anchor whether its context is repeated as a whole.
    # They are written, so that the joins are of plain exchanges, whose large partitions Spark can split.
    counts, path = written(places.groupBy("a", "x").agg(F.count("*").alias("n")), "contexts-counted")
    paths.append(path)
    grams = counts.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    grams, path = written(grams.select("a", (F.col("kinds") > 1).alias("differ")), "repeated-grams")
    paths.append(path)
    known, path = written(counts.join(grams, "a"), "known-contexts")
    paths.append(path)
    again, path = written(places.join(known, ["a", "x"]), "repeated-anchors")
    dropped(docs.sparkSession, *paths[1:])  # all but the texts
    paths[1:] = [path]
    # one copy of each different context, of grams that have several
    first = F.min(F.struct("h", "g", "place", "left", "right")).alias("o")
    distinct = again.where("differ").groupBy("a", "x").agg(first, F.max("n").alias("n")).select("a", "x", "n", "o.*")
    contexts, path = written(_contexts(texts, distinct), "contexts")
    paths.append(path)
    grouped, shared, used = _groups_to_sort(contexts, gram, length, group)
    parts = _sorted_groups(grouped, length)
    parts, path = written(parts if shared is None else parts.unionByName(shared), "parts")
    dropped(docs.sparkSession, *used)
    paths.append(path)
    # intervals of all texts; a context that occurs twice is covered whole, only the others need their parts
    interval = lambda left, right: F.struct((F.col("place") - left).alias("s"), (F.col("place") + right).alias("e"))
    whole = again.where("n > 1").select("h", "g", F.array(interval(F.col("left"), F.col("right"))).alias("c"))
    some = again.where("n = 1 and differ").join(parts, ["a", "x"])
    some = some.select("h", "g", F.transform("parts", lambda p: interval(p["l"], p["r"])).alias("c"))
    covered = whole.unionByName(some).groupBy("h", "g").agg(F.flatten(F.collect_list("c")).alias("covered"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, n, pairs in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                raw = text.encode("utf-8", "replace")
                if n > 1 and len(raw) >= length:
                    merged = [(0, len(raw))]
                else:
                    merged = _spans([(p["s"], p["e"]) for p in pairs or []])
                ends = [0, *[e for _, e in merged]]
                starts = [*[s for s, _ in merged], len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in merged])
                left = b"".join(raw[a:b] for a, b in zip(ends, starts))
                kept.append(left.decode("utf-8", "ignore").encode() if whole_characters else left)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["h", "g", "n_bytes", "spans", "kept"],
            )

    joined = texts.join(covered, ["h", "g"], "left").select("h", "g", "text", "n", "covered")
    done = joined.mapInArrow(cut, "h long, g int, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    done, _ = written(done.select("h", "g", *[c.alias(name) for name, c in columns.items()]), "repeats")
    dropped(docs.sparkSession, *paths)  # all that the result still reads is the table just written
    carried = F.struct(F.col(id_col), *[c.alias(name) for name, c in (carry or {}).items()]).alias("row")
    joined = docs.select(carried, *class_key(text_col)).join(done, ["h", "g"])
    return joined.select("row.*", *columns)
