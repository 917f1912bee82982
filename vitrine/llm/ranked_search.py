"""Operator 12: ranked lexical search with hashed max-sketches.

A document's terms have impacts, integers that grow with the term's share of the document.  They are folded into a
sketch: each term hashes to one of ``WIDTH`` coordinates, and a coordinate keeps the largest impact that falls there.
The sum of an item's weights times the coordinates of its terms is then never below the document's score.  A task looks
up a block of items in the sketches of a batch of documents at once, takes each item's documents by descending bound,
rescores them exactly, and stops where the bound is below the item's tenth score so far.  Terms are compared as bytes,
so scores are exact; the tasks' best are ranked together at the end.

Two passes over the texts: the first counts documents, terms and the documents of each item term, the second searches.
Items are read in blocks of bounded size, each block a pass of its own, so that what is broadcast has a bound.
"""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.chunks import slices
from vitrine.llm.common import whole_text, written

#: Coordinates of a sketch, documents of a batch, item terms looked up at once, entries of a worker's memo of hashes.
WIDTH, BATCH, TERMS_AT_ONCE, MEMO = 4096, 256, 4096, 500_000
#: Bytes of item texts that a block has on average, and a bound of what one pass broadcasts but for one longer item.
BLOCK_BYTES = 1 << 20

#: Lower-case letters for A-Z, blanks for every other ASCII character that is no letter or digit.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8 bytes: longest runs of ASCII letters, digits and characters beyond ASCII."""
    return text.encode("utf-8").translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_part(n: int, documents: int, total: int) -> int:
    """What a document's length adds to the divisor of its impacts."""
    return 100 - 75 + (75 * n * documents) // total


def impact(tf: int, m: int) -> int:
    """The part of a score that a term with ``tf`` occurrences gives for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Coordinates(dict):
    """Terms -> coordinates; starts anew when full."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[term] = at = zlib.crc32(term) % WIDTH
        return at


def sketches(counts: list[Counter], parts: list[int], coordinates: dict) -> np.ndarray:
    """One row for each document: the largest impact at each coordinate."""
    sizes = np.array([len(c) for c in counts])
    tf = np.fromiter((n for c in counts for n in c.values()), dtype=np.int64, count=int(sizes.sum()))
    at = np.fromiter((coordinates[t] for c in counts for t in c), dtype=np.int64, count=len(tf))
    row = np.repeat(np.arange(len(counts)), sizes)
    impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(np.array(parts, dtype=np.int64), sizes))
    out = np.zeros((len(counts), WIDTH), dtype=np.int64)
    np.maximum.at(out, (row, at), impacts)
    return out


class Items:
    """A block of items: their terms with repeats counted, weights, and the coordinates to look up."""

    def __init__(self, texts: list[str], documents: int, holding: dict[bytes, int]):
        self.terms = []
        for text in texts:
            known = ((t, n, holding.get(t, 0)) for t, n in Counter(terms(text)).items())
            self.terms.append([(t, n * weight(documents, df)) for t, n, df in known if df])
        flat = [(zlib.crc32(t) % WIDTH, w) for found in self.terms for t, w in found]
        self.at = np.array([a for a, _ in flat], dtype=np.int64)
        self.weights = np.array([w for _, w in flat], dtype=np.int64)
        #: Items with a term that some document has, and ranges of them with about TERMS_AT_ONCE terms.
        self.asked = [i for i, found in enumerate(self.terms) if found]
        self.starts = np.cumsum([0] + [len(self.terms[i]) for i in self.asked])
        self.groups, first = [], 0
        for j in range(len(self.asked)):
            if self.starts[j + 1] - self.starts[first] >= TERMS_AT_ONCE or j + 1 == len(self.asked):
                self.groups.append((first, j + 1))
                first = j + 1

    def bounds(self, sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, upper bound of its score in each document)."""
        for first, last in self.groups:
            a, b = self.starts[first], self.starts[last]
            products = sketch[:, self.at[a:b]] * self.weights[a:b]
            found = np.add.reduceat(products, self.starts[first:last] - a, axis=1)
            for j in range(first, last):
                yield self.asked[j], found[:, j - first]

    def score(self, item: int, counts: Counter, m: int) -> int:
        """The exact score of an item in a document."""
        return sum(w * impact(counts[t], m) for t, w in self.terms[item] if t in counts)


class Best:
    """The best ``k`` (score, id) of each item: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.kept = k, [[] for _ in range(items)]

    def least(self, item: int) -> int:
        """The score that a document must reach to matter."""
        kept = self.kept[item]
        return -kept[-1][0] if len(kept) == self.k else 1

    def offer(self, item: int, score: int, key) -> None:
        if score >= self.least(item):
            insort(self.kept[item], (-score, key is None, key if key is not None else 0))
            del self.kept[item][self.k :]


def searched(items: Items, best: Best, keys: list, texts: list[str], documents: int, total: int, coordinates: dict) -> int:
    """Search one batch of documents; returns how many exact scores were needed."""
    found = [terms(t) for t in texts]
    parts = [length_part(len(f), documents, total) for f in found]
    counts = [Counter(f) for f in found]
    rescored = 0
    for item, bound in items.bounds(sketches(counts, parts, coordinates)):
        likely = np.flatnonzero(bound >= best.least(item))
        for d in likely[np.argsort(-bound[likely], kind="stable")].tolist():
            if bound[d] < best.least(item):
                break
            rescored += 1
            best.offer(item, items.score(item, counts[d], parts[d]), keys[d])
    return rescored


def _statistics(docs: DataFrame, asked: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, terms of all documents, and the documents that hold each of ``asked``."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        sums = np.zeros(len(place) + 2, dtype=np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = terms(text)
                sums[-2] += bool(found)
                sums[-1] += len(found)
                for t in place.keys() & set(found):
                    sums[place[t]] += 1
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some), pa.array(sums[some])], names=["at", "n"])

    summed = docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row for each item term of the block
    n = {r["at"]: r["n"] for r in summed}
    return n.get(len(asked), 0), n.get(len(asked) + 1, 0), {t: n.get(i, 0) for i, t in enumerate(asked)}


def _block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(item, id, score): each item's best ``k`` of all documents, not yet numbered."""
    spark = docs.sparkSession
    documents, total, holding = _statistics(docs, sorted({t for text in texts for t in terms(text)}))
    shared = spark.sparkContext.broadcast((texts, documents, total, holding))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, documents, total, holding = shared.value
        items, coordinates = Items(texts, documents, holding), _Coordinates()
        best, arrow_type = Best(len(texts), k), None
        for batch in batches:
            arrow_type = batch.schema.field(0).type
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(bodies):
                for c in range(a, b, BATCH):
                    searched(items, best, keys[c : min(b, c + BATCH)], bodies[c : min(b, c + BATCH)], documents, total, coordinates)
        rows = [(i, None if empty else key, -s) for i, kept in enumerate(best.kept) for s, empty, key in kept]
        if rows:
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], arrow_type), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.record_batch(columns, names=["item", "id", "score"])

    return docs.mapInArrow(run, f"item long, id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's ``k`` highest-scoring documents: (item, rank int, id, score long).

    Scores are above 0; equal scores go by ascending id, null ids last; ranks are from 1 and unique.  Null and empty texts
    have no terms: such a document is never found and not counted, such an item finds nothing.  Repeated document rows are
    documents of their own; rows of items with equal id and text are one item, with equal id and different texts items of
    their own; a null item id stays null.  Empty tables give no rows.  Other columns are not carried.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), whole_text(f"`{item_text}`").alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt, _ = written(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    parts = []
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()  # about block_bytes of items
        if rows:
            numbers = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {dict(dealt.dtypes)['item_id']}")
            order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
            ranked = _block(read, [r["text"] for r in rows], k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            parts.append(ranked.join(F.broadcast(numbers), "item").select("item_id", "rank", "id", "score"))
            if blocks > 1:
                parts[-1] = written(parts[-1], "ranked")[0]
    empty = spark.createDataFrame([], f"item_id {dict(dealt.dtypes)['item_id']}, rank int, id {dict(read.dtypes)['id']}, score long")
    found = reduce(DataFrame.unionByName, parts) if parts else empty
    return found.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
