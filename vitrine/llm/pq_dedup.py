"""Operator 3: near-duplicate embeddings through coarse inverted lists and product quantisation.

Equal vectors are collapsed first.  K-means centroids cut the unit sphere into cells; the residual of each vector in its
cell is coded by subspace codebooks.  The two ends of a link lie on either side of the plane halfway between their cells'
centroids, so one of them is within half the link's length of it: a vector probes every cell whose plane is that near,
and no link is lost.  In each cell asymmetric distances, summed from a table of inner products with the codewords, leave
only candidates that can be near enough given their own coding error; exact cosines decide.  A pair that can be found
from both sides is counted on one.  Tasks hold bounded blocks of a cell's list and of its probes, and give out one count and one link to a
representative per vector, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import dropped, written
from vitrine.llm.components import components
from vitrine.llm.vectors import dimension, matrix, usable

#: Vectors that centroids and codebooks are fitted on, vectors for each cell, and list entries and probes that meet in
#: one task.
SAMPLE_ROWS, CELL_ROWS, BLOCK_ROWS = 16384, 128, 4096


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    sizes = (centroids**2).sum(axis=1)
    return np.concatenate([(sizes - 2 * points[at : at + 1024] @ centroids.T).argmin(axis=1) for at in range(0, len(points), 1024)])


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of at most ``k`` clusters; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centroids)
        counts = np.bincount(nearest, minlength=len(centroids))
        order = np.argsort(nearest, kind="stable")
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(points[order], (np.cumsum(counts) - counts)[filled], axis=0)
        centroids[filled] = sums / counts[filled, None]
    return centroids


@dataclass
class Index:
    """Centroids (cells x d) and codebooks (subspaces x codes x d / subspaces)."""

    centroids: np.ndarray
    books: np.ndarray

    def cells(self, units: np.ndarray, cosine: float, margin: float = 0.0) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's own cell, and all that it probes: those whose bisecting plane with the own one is at most half
        as far as two vectors of ``cosine`` can be apart, and those at most ``margin`` farther than the own one."""
        sizes = (self.centroids**2).sum(axis=1)
        squares = np.maximum(1 + sizes - 2 * units @ self.centroids.T, 0)
        own, least = squares.argmin(axis=1), squares.min(axis=1)[:, None]
        apart = np.sqrt(np.maximum(sizes[own][:, None] + sizes - 2 * self.centroids[own] @ self.centroids.T, 0))
        # the distance to the plane is (square - least) / (2 * apart)
        near = squares - least <= math.sqrt(max(2 - 2 * cosine, 0)) * (apart + 1e-6) + 1e-9
        if margin > 0:
            near |= np.sqrt(squares) <= np.sqrt(least) + margin
        return own, [np.flatnonzero(row) for row in near]

    def encode(self, units: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors of one cell, and the vectors that they stand for."""
        parts, codes, width = [], [], self.books.shape[2]
        residual = units - self.centroids[cell]
        for s, book in enumerate(self.books):
            part = residual[:, s * width : (s + 1) * width]
            code = ((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)
            codes.append(code)
            parts.append(book[code])
        return np.array(codes), self.centroids[cell] + np.hstack(parts)


def fit(sample: np.ndarray, cells: int, subspaces: int, codes: int, seed: int = 11) -> Index:
    """Fit on unit vectors; the dimension is a multiple of ``subspaces``."""
    centroids = k_means(sample, cells, 8, seed)
    nearest = _nearest(sample, centroids)
    residual, width = sample - centroids[nearest], sample.shape[1] // subspaces
    books = [k_means(residual[:, s * width : (s + 1) * width], codes, 8, seed + s) for s in range(subspaces)]
    return Index(centroids, np.array(books))


def _units(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1)[:, None]  # first to a size whose square neither overflows nor vanishes
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of nodes after the pairs (a, b) have been joined; a label is the least node known to hang together with its
    own, and ``label`` holds such labels before."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter


def _match(index: Index, cell: int, listed: pa.Table, probing: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, weighted link count, linked representative) of one block of a cell's list and one block of its probes."""
    ids, units, weights = listed["id"].to_numpy(), _units(matrix(listed["v"])), listed["n"].to_numpy()
    qids, qunits, qweights = probing["id"].to_numpy(), _units(matrix(probing["v"])), probing["n"].to_numpy()
    qcell, cells = probing["cell_own"].to_numpy().astype(np.int64), len(index.centroids)
    lists = listed["probes"].combine_chunks()
    probes = np.sort(np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()) * cells + lists.flatten().to_numpy())
    codes, stand = index.encode(units, cell)
    error = np.sqrt(((units - stand) ** 2).sum(axis=1))
    reach = (math.sqrt(max(2 - 2 * cosine, 0)) + error + 1e-9) ** 2
    norms = (stand**2).sum(axis=1)
    centre, width, q = index.centroids[cell], index.books.shape[2], len(qids)
    counts = np.zeros(q + len(ids), dtype=np.int64)
    label = np.arange(q + len(ids))
    for at in range(0, q, 256):
        part = qunits[at : at + 256]
        inner = np.repeat((part @ centre)[:, None], len(ids), axis=1)
        for s, book in enumerate(index.books):
            inner += (part[:, s * width : (s + 1) * width] @ book.T)[:, codes[s]]
        near_q, near_l = np.nonzero(1 + norms - 2 * inner <= reach)
        near_q += at
        for lo in range(0, len(near_q), 65536):
            i, j = near_q[lo : lo + 65536], near_l[lo : lo + 65536]
            exact = (qunits[i] * units[j]).sum(axis=1) >= cosine
            i, j = i[exact], j[exact]
            # the same pair also turns up in the probe's own cell if the other one probes that; it counts where the
            # smaller id probes
            code = j * cells + qcell[i]
            twice = probes[np.minimum(np.searchsorted(probes, code), len(probes) - 1)] == code
            once = (qids[i] != ids[j]) & ~((qids[i] > ids[j]) & twice)
            i, j = i[once], j[once]
            np.add.at(counts, i, weights[j])
            np.add.at(counts, q + j, qweights[i])
            label = united(label, i, q + j)
    some = np.flatnonzero(counts)
    both = np.append(qids, ids)
    return both[some], counts[some], both[label[some]]


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.95,
    margin: float = 0.0,
    subspaces: int = 8,
    codes: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component): other vectors of cosine at least ``cosine``, and the least id reachable over such links.

    One row for each input row.  Vectors that are null, zero, hold null or non-finite components, or are not as long as
    most, have no links and are their own component.  No link is missed; a ``margin`` above 0 only adds probes.  Equal vectors are linked to each other.  Rows with the same id are
    separate vectors that share the id; rows with a null id have no links and a null component.  Centroids and codebooks
    are fitted on at most ``SAMPLE_ROWS`` different vectors, those with the smallest hash; every vector is indexed.  An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    size = dimension(raw, "v")
    ok = usable("v") & (F.size("v") == size) & F.col("id").isNotNull()
    named = raw.withColumn("ok", F.coalesce(ok, F.lit(False)))
    named, named_path = written(named.select("id", "v", "ok", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")), "vectors")
    classes = named.where("ok").groupBy("h", "g").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("n"))
    classes, class_path = written(classes, "classes")
    sample = [r["v"] for r in classes.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE_ROWS).select("v").collect()]
    if not sample:
        return named.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    total = classes.count()
    subspace_count = next(s for s in range(min(subspaces, size), 0, -1) if size % s == 0)
    index = fit(_units(np.array(sample, dtype=np.float64)), max(1, min(len(sample) // 4, total // CELL_ROWS)), subspace_count, codes)
    shared = spark.sparkContext.broadcast(index)  # at most a quarter of the sample's rows as centroids, and the codebooks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cells, probes = shared.value.cells(_units(matrix(part.column(2))), cosine, margin)
                lists = pa.array([p.tolist() for p in probes], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.astype(np.int32)), lists], names=["h", "g", "v", "id", "n", "cell_own", "probes"])

    kinds = dict(classes.dtypes)
    placed = classes.select("h", "g", "v", "id", "n").mapInArrow(place, f"h long, g long, v {kinds['v']}, id long, n long, cell_own int, probes array<int>")
    placed, placed_path = written(placed, "placed")
    # pieces of each cell's list and of its probes; a cell without probes or list has one
    probing = spark.read.schema(placed.schema).parquet(placed_path)  # the same rows under other names to Spark
    probed = probing.select("id", "v", "n", "cell_own", F.explode("probes").alias("cell"))
    lists = {r["cell_own"]: r["count"] for r in placed.groupBy("cell_own").count().collect()}
    asks = {r["cell"]: r["count"] for r in probed.select("cell").groupBy("cell").count().collect()}
    sizes = [(c, math.ceil(lists.get(c, 0) / BLOCK_ROWS) or 1, math.ceil(asks.get(c, 0) / BLOCK_ROWS) or 1) for c in range(len(index.centroids))]
    pieces = lambda: F.broadcast(spark.createDataFrame(sizes, "cell int, held int, asked int"))  # noqa: E731  one row for each cell
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.withColumnRenamed("cell_own", "cell").join(pieces(), "cell").select("cell", deal("held").alias("i"), spread("asked").alias("j"), "id", "v", "n", "probes")
    right = probed.join(pieces(), "cell").select("cell", spread("held").alias("i"), deal("asked").alias("j"), "id", "v", "n", "cell_own")

    def run(listed: pa.Table, probing: pa.Table) -> pa.Table:
        columns: tuple = ([], [], [])
        if listed.num_rows and probing.num_rows:
            columns = _match(shared.value, listed["cell"][0].as_py(), listed, probing, cosine)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "n_links", "root"])

    matched = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(run, "id long, n_links long, root long")
    matched, matched_path = written(matched, "matched")
    roots, roots_path = written(components(matched.select(F.col("id").alias("a"), F.col("root").alias("b"))), "roots")
    counts = matched.groupBy("id").agg(F.sum("n_links").alias("linked"))
    known = classes.select("h", "g", "id", "n").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("h", "g", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component"))
    found = named.where("ok").select("id", "h", "g").join(known, ["h", "g"]).select("id", "n_links", "component")
    rest = named.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    result, _ = written(found.unionByName(rest).withColumnRenamed("id", id_col), "links-and-groups")
    shared.unpersist()
    dropped(spark, named_path, class_path, placed_path, matched_path, roots_path)
    return result
