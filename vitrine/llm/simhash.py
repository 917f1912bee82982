"""Operator 8: SimHash near-duplicates through BK-trees.

A fingerprint's bits are the majority votes of its shingles' hashes.  Equal fingerprints are first collapsed, so copies
count once.  Two fingerprints at most r bits apart agree in at least one of r + 1 blocks of bits; every fingerprint goes
to one shard for each block, and shards above a size are cut again by blocks of the remaining bits, which keeps every
pair together somewhere.  What is still too large is dealt into blocks of rows, and each pair of blocks is a shard of its
own, so that no task holds more than two blocks and no pair is lost.  Each shard is a BK-tree: a node's children are
keyed by their Hamming distance to it, and a search follows the edges whose distance differs from the node's by at most
r; it ends early once everything in the tree is linked.  A shard gives its links as a star to each cluster's least
member, never as all pairs; the stars' connected components are the groups.

The trees stay in the tasks that hold their shards and are not broadcast: together they hold every fingerprint, for
which no bound exists.

Few bits tell copies apart from others, but not texts that share four fifths of their shingles: these differ in about
ten of 64 bits.  ``similar_groups`` therefore shards by least shingle hashes, which such texts share, gives the trees a
wide radius, and compares the shingles themselves before it links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bucketed, dropped, shuffle_width, whole_text, written
from vitrine.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Fingerprints in a shard above which it is cut by further blocks of bits.
SHARD_ROWS = 4096


def shingles(text: str, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; of the whole sequence where there are fewer words."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[min(width, len(words)) - 1 :]
    first = (ends - sizes)[: len(last)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(first.tolist(), last.tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 of none."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 65536):
        ones += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text; 0 for a text without words."""
    return majority(shingles(text, width, seed))


def with_fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint of every whole text as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, width, seed) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=[id_col, "fp"])

    kept = docs.select(F.col(id_col), whole_text(text_col).alias("__text"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, fp long")


class BKTree:
    """Integers under Hamming distance, with a union of what has been linked so far.

    ``same`` decides on the numbers of two members within the radius whether they are linked; by default all are.
    """

    def __init__(self, radius: int, same: Callable[[int, int], bool] | None = None):
        self.radius, self.same = radius, same
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.clusters = 0

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, value: int) -> None:
        """Link a value with the members within the radius, then hang it into the tree."""
        new, radius, values, edges = len(self.values), self.radius, self.values, self.edges
        values.append(value)
        edges.append({})
        self.parent.append(new)
        self.clusters += 1
        stack = [0] if new else []
        while stack and self.clusters > 1:
            node = stack.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                a, b = self._root(node), self._root(new)
                if a != b and (self.same is None or self.same(node, new)):
                    self.parent[max(a, b)] = min(a, b)
                    self.clusters -= 1
            stack += [child for key, child in edges[node].items() if -radius <= key - distance <= radius]
        node = 0
        while node != new:
            node = edges[node].setdefault((values[node] ^ value).bit_count(), new)

    def stars(self) -> Iterator[tuple[int, int]]:
        """(member, representative), by number, of every member that is linked to an earlier one."""
        for i in range(len(self.values)):
            if (root := self._root(i)) != i:
                yield i, root


def _blocks(low: int, high: int, pieces: int) -> list[tuple[int, int]]:
    """Bit ranges [a, b) that cut [low, high) into pieces."""
    at = [low + (high - low) * i // pieces for i in range(pieces + 1)]
    return list(zip(at, at[1:]))


def _shards(fps: DataFrame, radius: int, limit: int) -> DataFrame:
    """(key, fp): every pair within the radius shares a key; shards above the limit are cut once more by bits, and then
    into pairs of blocks.

    Each of the r + 1 blocks of about 64 / (r + 1) bits gives a key.  In a shard above the limit all agree on that
    block, so a pair agrees on one of r + 1 parts of the other bits too, and these parts give the keys.  With r = 4 the
    two cuts take 22 bits, about four million shards for each pair of blocks.
    """
    blocks = [range(a, b) for a, b in _blocks(0, 64, radius + 1)]

    def key(bits: list[int], *more) -> Column:
        mask = sum(1 << x for x in bits)
        return F.xxhash64(*more, F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))

    def parts(i: int) -> Column:
        free = [x for j, block in enumerate(blocks) if j != i for x in block]
        return F.array(*[key(free[a:b], F.col("key"), F.lit(j)) for j, (a, b) in enumerate(_blocks(0, len(free), radius + 1))])

    first = F.array(*[F.struct(F.lit(i).alias("at"), key(list(b), F.lit(i)).alias("key")) for i, b in enumerate(blocks)])
    coarse = fps.select("fp", F.explode(first).alias("k")).select("fp", "k.at", "k.key")
    large, _ = written(coarse.groupBy("key").count().where(F.col("count") > limit).select("key"), "large-shards")
    if not large.limit(1).count():
        return coarse.select("key", "fp")
    finer = F.element_at(F.array(*[parts(i) for i in range(radius + 1)]), F.col("at") + 1)
    cut = coarse.join(large, "key", "left_semi").select("fp", F.explode(finer).alias("key"))
    return coarse.join(large, "key", "left_anti").select("key", "fp").unionByName(_in_blocks(cut, "fp", limit))


def _in_blocks(keyed: DataFrame, member: str, limit: int) -> DataFrame:
    """Rows with a key, those of keys with more than ``limit`` rows dealt by a hash of ``member`` into blocks of about half
    as many; each pair of blocks gets a key of its own.  The rows of keys with one row are left out."""
    counts, _ = written(keyed.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1"), "shard-sizes")
    sized = keyed.join(counts, "key")
    pieces = F.ceil(F.col("__n") * 2 / limit).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), member), pieces).cast("int")
    whole = sized.where(F.col("__n") <= limit).drop("__n")
    dealt = sized.where(F.col("__n") > limit).withColumn("__i", own).withColumn("__j", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return whole.unionByName(dealt.withColumn("key", F.xxhash64("key", F.least("__i", "__j"), F.greatest("__i", "__j"))).drop("__n", "__i", "__j"))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each key, which is the first column; they come in the order of keys."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def linked(fps: DataFrame, radius: int = 4, limit: int = SHARD_ROWS) -> DataFrame:
    """(a, b): fingerprints and a linked representative in one of their shards; spans every group.  ``fps``: distinct fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in _by_key(batches):
            tree = BKTree(radius)
            for _, fp in rows:
                tree.add(fp & 0xFFFFFFFFFFFFFFFF)
            out += [(rows[i][1], rows[r][1]) for i, r in tree.stars()]
            if len(out) > 10000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    keyed = _shards(fps, radius, limit).repartition(shuffle_width(fps.sparkSession), "key").sortWithinPartitions("key")
    return keyed.mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(rows, dtype=np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component): fingerprint and the least id that is reachable over links of at most ``radius`` bits.

    One row for each input row.  Texts of fewer than ``width`` words are one shingle; null, empty and blank texts have
    fingerprint zero and are linked like any other.  Equal texts share a fingerprint.  Rows with a null id get a
    component like the others; a component whose ids are all null has a null one.  Other columns are not carried.
    """
    marked, _ = written(with_fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    links, path = written(linked(least.select("fp"), radius), "links")
    roots, root_path = written(components(links), "roots")
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # both written, so that the join of a large group's fingerprints is one of plain exchanges, which Spark can split
    named, _ = written(named, "named")
    dropped(docs.sparkSession, path, root_path)
    group, _ = written(named.groupBy("root").agg(F.min("least").alias("component")), "groups")
    labels = named.select("fp", "root").join(group, "root").select("fp", "component")
    return marked.join(labels, "fp").select(id_col, "fp", "component")


def _with_keys(docs: DataFrame, width: int, bands: int, seed: int) -> DataFrame:
    """(row, fp, n, h, keys) of rows with their text: fingerprint, number of different shingles, a hash of their set, and
    ``bands`` hashes of two least hashes each.  Texts that share four fifths of their shingles share one such key with
    probability 0.64."""
    odd = np.random.default_rng(seed).integers(1, 1 << 63, size=2 * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text in batch.column(1).to_pylist():
                every = shingles(text, width, seed)
                some = np.unique(every)
                least = np.zeros(2 * bands, dtype=np.uint64)
                for i, by in enumerate(odd if len(some) else ()):
                    mixed = some * by
                    least[i] = ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)).min()
                digests = [xxhash.xxh64_intdigest(least[2 * i : 2 * i + 2].tobytes(), i) for i in range(bands)]
                for held, value in zip(out, (majority(every), len(some), xxhash.xxh64_intdigest(some.tobytes()), digests)):
                    held.append(value)
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            flat = signed([d for k in out[3] for d in k])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(out[3]) + 1, dtype=np.int32) * bands), flat)
            yield pa.record_batch([batch.column(0), signed(out[0]), pa.array(out[1], pa.int64()), signed(out[2]), keys], names=["row", "fp", "n", "h", "keys"])

    return docs.mapInArrow(run, "row long, fp long, n long, h long, keys array<long>")


def _candidates(keyed: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(members array): rows of a shard that hang together by fingerprints within the radius and numbers of shingles that
    allow the similarity.  ``keyed``: key, row, fp, n, in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            sizes = [r[3] for r in rows]
            tree = BKTree(radius, lambda i, j: min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]))  # noqa: B023
            for r in rows:
                tree.add(r[2] & 0xFFFFFFFFFFFFFFFF)
            groups: dict[int, list[int]] = {}
            for i, root in tree.stars():
                groups.setdefault(root, [rows[root][1]]).append(rows[i][1])
            if groups:
                yield pa.record_batch([pa.array([sorted(g) for g in groups.values()], pa.list_(pa.int64()))], names=["members"])

    return keyed.mapInArrow(run, "members array<long>")


def _verified(texts: DataFrame, radius: int, similarity: float, width: int, seed: int) -> DataFrame:
    """(a, b): rows and a representative whose shingles are similar enough; ``texts``: group, row, text, in the order of
    groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            values, sets = [], []
            for r in rows:
                every = shingles(r[2], width, seed)
                values.append(majority(every))
                sets.append(np.unique(every))

            def same(i: int, j: int) -> bool:
                small, large = sorted((sets[i], sets[j]), key=len)  # noqa: B023
                if len(small) < similarity * len(large):
                    return False
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                return both >= similarity * (len(small) + len(large) - both)

            tree = BKTree(radius, same)
            for value in values:
                tree.add(value)
            found = [(rows[i][1], rows[r][1]) for i, r in tree.stars()]
            if found:
                yield _pairs(found)

    return texts.mapInArrow(run, "a long, b long")


def similar_groups(texts: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24, bands: int = 8, limit: int = 2048, seed: int = 42) -> DataFrame:
    """(row, root): the least row number that is reachable over pairs of texts whose different shingles of ``width`` words
    have a Jaccard similarity of at least ``similarity``, for the least row of each set of shingles only.

    ``texts``: row, text, a written table bucketed by row, so that candidates' texts come to it.  Texts without words
    are equal to each other.  Every link is checked on the shingles themselves.  Of the pairs at a similarity of 0.8,
    0.03 % share no shard; the radius leaves out those whose fingerprints differ in more bits.
    """
    width_of = shuffle_width(texts.sparkSession)
    marked = _with_keys(texts, width, bands, seed)
    one = F.min(F.struct("row", "fp", "n", "keys")).alias("o")
    classes, class_path = written(marked.groupBy("h").agg(one).select("o.*"), "shingle-sets")
    keyed = _in_blocks(classes.select("row", "fp", "n", F.explode("keys").alias("key")), "row", limit)
    keyed = keyed.select("key", "row", "fp", "n").repartition(width_of, "key").sortWithinPartitions("key")
    groups, group_path = written(_candidates(keyed, radius, similarity).distinct(), "candidate-groups")
    asked = groups.select(F.xxhash64("members").alias("group"), F.explode("members").alias("row"))
    found = texts.join(asked, "row").select("group", "row", "text").repartition(width_of, "group").sortWithinPartitions("group")
    links, link_path = written(_verified(found, radius, similarity, width, seed), "links")
    roots, root_path = written(components(links), "roots")
    known, _ = written(classes.select("row").join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("root", "row").alias("root")), "groups")
    dropped(texts.sparkSession, class_path, group_path, link_path, root_path)
    return known


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of near-duplicates.

    Near-duplicates are texts with a Jaccard similarity of at least ``similarity`` between their shingles of ``width``
    words, and what is reachable over such pairs; texts without words are one group.  Rows are told apart by a number of
    the staged table, so null and repeated ids make no difference; the row with the least number stays.  The rows are
    staged as one struct, so no column's name can clash.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    staged, _ = bucketed(docs.select(F.monotonically_increasing_id().alias("row"), every), "numbered", "row")
    groups = similar_groups(staged.select("row", whole_text(F.col("doc").getField(text_col)).alias("text")), width, similarity)
    return staged.join(groups.where("row = root").select("row"), "row", "left_semi").select("doc.*")
