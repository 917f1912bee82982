"""Exact nearest vectors with pruned cells.

Vectors at length one are dealt to the cell of their nearest pivot; a cell knows how far its members lie from the pivot.
By the triangle inequality no member is nearer to a query than the query's distance to the pivot less that radius, so a
cell whose bound is beyond the k-th distance found so far cannot hold a nearer one and is not read.  The pivots are a
bounded sample; they decide what is read, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.operators.staging import staged

#: Members that a cell has on average, cells at most (their pivots are broadcast), and rows of a block of a cell.
CELL_ROWS, CELLS, BLOCK_ROWS = 2048, 4096, 32768
#: Slack for rounding in distances, entries of a matrix that a task makes at once, packs of cells at least, and folders of
#: stored packs (about).
SLACK, ENTRIES, PACKS, FOLDERS = 1e-7, 1 << 21, 8, 64


def pivots(members: DataFrame, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Unit vectors (id, v) chosen by a hash of the id: one for ``cell_rows`` members, ``CELLS`` at most."""
    n = members.count()
    size = min(CELLS, max(1, math.ceil(n / cell_rows)))
    chosen = members.orderBy(F.xxhash64("id"), "id").limit(size).select("v").collect()  # at most CELLS
    return np.array([r["v"] for r in chosen], dtype=float).reshape(len(chosen), -1 if chosen else 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit (or zero) vectors."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def celled(members: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each unit vector (id, v and other columns) with its nearest pivot's number, cell, and its distance to it, far."""
    shared = members.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ENTRIES // len(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                away = _distances(_vectors_of(part.column("v")), shared.value)
                cell = away.argmin(axis=1)
                added = [pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])]
                yield pa.record_batch([*part.columns, *added], names=[*part.schema.names, "cell", "far"])

    kept = ", ".join(f"`{name}` {kind}" for name, kind in members.dtypes)
    return members.mapInArrow(place, f"{kept}, cell int, far double")


def _reach(cells: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(radius, members) of each cell: one row for each."""
    radius, size = np.zeros(n), np.zeros(n, dtype=np.int64)
    for r in cells.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["far"], r["n"]
    return radius, size


def _first_cells(bound: np.ndarray, away: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Which cells each query looks into first: the nearest ones, until they have more than ``k`` members."""
    order = np.argsort(np.where(size > 0, away, np.inf), axis=1)
    so_far = np.cumsum(size[order], axis=1) - size[order]
    chosen = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(chosen, order, (so_far <= k) & (size[order] > 0), axis=1)
    return chosen


def _vectors_of(column) -> np.ndarray:
    """The vectors of an Arrow column, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _limits(least: np.ndarray) -> np.ndarray:
    """How far a member may be that is as good as these scores: cosines are 1 - d * d / 2."""
    return np.sqrt(np.maximum(2 - 2 * least, 0)) + SLACK


def _probes(queries: DataFrame, centres: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int, packs: np.ndarray | None = None) -> DataFrame:
    """(id, v, least, cell, n) rows of what a query (id, v) looks into: its first cells; or, with ``packs``, the pack of each
    cell, and ``least``, the score of a query's k-th so far, a row for each pack with cells that may hold as good a one, and
    how many cells these are.  A query without k so far takes all."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, radius, size, packs))
    known = packs is not None
    rows = queries if known else queries.withColumn("least", F.lit(None).cast("double"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, size, packs = shared.value
        several = int(packs.max()) + 1 if known else 1
        step = max(1, min(ENTRIES // len(centres), ENTRIES // 16 // several))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                away = _distances(_vectors_of(part.column(1)), centres)
                bound = np.maximum(away - radius, 0)
                if known:
                    limit = _limits(np.nan_to_num(part.column(2).to_numpy(zero_copy_only=False).astype(float), nan=-1.0))
                    wanted = (bound <= limit[:, None]) & (size > 0)
                    counts = np.zeros((len(away), several), dtype=np.int32)
                    for pack in range(several):
                        counts[:, pack] = wanted[:, packs == pack].sum(axis=1)
                else:
                    counts = _first_cells(bound, away, size, k).astype(np.int32)
                r, c = np.nonzero(counts)
                some = part.take(pa.array(r))
                yield pa.record_batch([*some.columns, pa.array(c.astype(np.int32)), pa.array(counts[r, c])], names=["id", "v", "least", "cell", "n"])

    return rows.select("id", "v", "least").mapInArrow(look, f"id {dict(queries.dtypes)['id']}, v array<double>, least double, cell int, n int")


def _packed(centres: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """The pack of each cell: neighbours in a chain of near pivots, together at most ``rows`` members or one cell."""
    packs, left, at, pack, n = np.zeros(len(centres), dtype=np.int64), np.ones(len(centres), dtype=bool), 0, 0, 0
    for _ in range(len(centres)):
        left[at] = False
        if n and n + size[at] > rows:
            pack, n = pack + 1, 0
        packs[at], n = pack, n + size[at]
        at = int(np.where(left, centres @ centres[at], -np.inf).argmax())
    return packs


def best_of(one: pa.Table, two: pa.Table, k: int, reach: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """The best ``k`` of the vectors of ``two`` (id, v, at: their cell) for each of ``one`` (id, v, least): id, other, score;
    ties to the smaller id.  Where ``least`` is known, only scores as high, and only cells that may hold one by ``reach``,
    their pivots and radii.  Products are made of few rows at once."""
    names = ["id", "other", "score"]
    others, kind = two.column("id").to_numpy(), one.schema.field("id").type
    if not one.num_rows or not two.num_rows:
        return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names=names)
    cell = two.column("at").to_numpy()
    order = np.lexsort((np.argsort(np.argsort(others, kind="stable")), cell))  # by cell, then id
    others, b, cell = others[order], _vectors_of(two.column("v"))[order], cell[order]
    inside, starts = np.unique(cell, return_index=True)
    place = np.argsort(np.argsort(others, kind="stable"))
    ids, a = one.column("id").to_numpy(), _vectors_of(one.column("v"))
    least = np.nan_to_num(one.column("least").to_numpy().astype(float), nan=-1.0)
    pivots, radius = reach[0][inside], reach[1][inside]
    step = max(1, min(ENTRIES // len(others), ENTRIES // len(inside), 1024))
    near = np.concatenate([(a[at : at + 1024] @ pivots.T).argmax(axis=1) for at in range(0, len(a), 1024)])
    queries = np.argsort(near, kind="stable")  # queries of one cell want the same cells
    _, counts = np.unique(others, return_counts=True)
    own, found = int(counts.max()), []
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        wanted = (np.maximum(_distances(a[some], pivots) - radius, 0) <= _limits(least[some])[:, None]).any(axis=0)
        if not wanted.any():
            continue
        column = np.nonzero(np.repeat(wanted, np.diff(np.append(starts, len(cell)))))[0]
        whole = len(column) == len(cell)
        scores = a[some] @ (b if whole else b[column]).T
        floor = least[some] - SLACK
        hit = scores >= floor[:, None]
        if len(column) > k + own and np.count_nonzero(hit) > hit.size // 8:
            last = len(column) - k - own  # as many more as may be the query's own
            hit = scores >= np.maximum(floor, np.partition(scores, last, axis=1)[:, last])[:, None]
        row, c = np.divmod(np.flatnonzero(hit), len(column))
        other = ids[some[row]] != others[column[c]]
        row, c = row[other], c[other]
        value, c = scores[row, c], column[c]
        sort = np.lexsort((place[c], -value, row))  # ties at the k-th place go to the smaller id
        row, c, value = row[sort], c[sort], value[sort]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((some[row[top]], c[top], value[top]))
    r, c, value = (np.concatenate(x) for x in zip(*found)) if found else (np.array([], int), np.array([], int), np.array([], float))
    return pa.table([pa.array(ids[r], kind), pa.array(others[c], kind), pa.array(value, pa.float64())], names=names)


def _met(probes: DataFrame, cells: DataFrame, size: np.ndarray, k: int, block_rows: int, reach: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The best ``k`` that each probe finds in its cell or pack (``cells``: id, v, cell, at): (id, other, score).  Its members
    are dealt into blocks of ``block_rows``, and so are its probes, so a cell that holds most rows is many tasks."""
    spark = cells.sparkSession
    blocks = spark.createDataFrame([(c, max(1, math.ceil(int(n) / block_rows))) for c, n in enumerate(size) if n], "cell int, blocks long")  # a row for each cell
    asked = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    groups = spark.createDataFrame([(c, max(1, math.ceil(n / block_rows))) for c, n in asked.items()], "cell int, groups long")
    both = F.broadcast(blocks.join(groups, "cell"))
    left = probes.join(both, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("groups")).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), "id", "v", "least")
    right = cells.join(both, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).alias("b"), "id", "v", "at")
    keys = ["cell", "g", "b"]
    kind = dict(probes.dtypes)["id"]
    shared = spark.sparkContext.broadcast(reach)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda one, two: best_of(one, two, k, shared.value), f"id {kind}, other {kind}, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, members: DataFrame, k: int, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """The best ``k`` members of every query: (id, other, score, rank).  ``report`` gets the share of the pairs of query and
    cell that were looked into.

    ``queries`` and ``members``: id, v, a unit or zero vector, all of one length; rows with equal ids are not others of
    each other.  A query first looks into the nearest cells that hold more than ``k``, then into all that its k-th score so
    far does not rule out; for this, near cells lie together in packs of ``block_rows``.  Zero vectors, whose cosine is 0 with all, lie in a cell of their own that such a
    bound covers.
    """
    members = staged(members.select("id", "v"), "members")
    if members.isEmpty():
        kind = dict(queries.dtypes)["id"]
        return queries.sparkSession.createDataFrame([], f"id {kind}, other {kind}, score double, rank int")
    squares = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    zero = members.where(squares == 0)
    some = members.where(squares > 0)
    centres = pivots(some, cell_rows)
    if not len(centres):
        centres = np.zeros((1, len(members.first()["v"])))
    cells = staged(celled(some, centres), "cells")
    radius, size = _reach(cells, len(centres))
    asked = staged(queries.select("id", "v"), "queries")
    lengths = asked.where(squares > 0)
    reach = (centres, radius)
    cells = cells.withColumn("at", F.col("cell"))
    first = staged(_probes(lengths, centres, radius, size, k), "probes")
    found = _ranked(_met(first, cells, size, k, block_rows, reach), k)
    least = staged(found.groupBy("id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least")), "least")
    # near cells are met together, so a query's vector is moved once for many cells
    pack_rows = min(block_rows, max(1, math.ceil(int(size.sum()) / PACKS)))
    packs = _packed(centres, size, pack_rows)
    packed = F.broadcast(members.sparkSession.createDataFrame([(c, int(p)) for c, p in enumerate(packs)], "at int, pack int"))  # a row for each cell
    second = staged(_probes(lengths.join(least, "id", "left"), centres, radius, size, k, packs), "probes")
    if report is not None:
        report["share"] = (first.count() + (second.agg(F.sum("n")).first()[0] or 0)) / max(lengths.count() * int((size > 0).sum()), 1)
    together = cells.join(packed, "at").select("id", "v", F.col("pack").alias("cell"), "at")
    more = [_met(second, together, np.bincount(packs, size), k, pack_rows, reach)]
    # zero vectors: as members for all queries the k of least id, as queries the k members of least id
    least_ids = lambda df: df.orderBy("id").limit(k + 1).select(F.col("id").alias("other"), F.lit(0.0).alias("score"))
    more.append(lengths.select("id").join(F.broadcast(least_ids(zero)), F.col("id") != F.col("other")))
    more.append(asked.where(squares == 0).select("id").join(F.broadcast(least_ids(members)), F.col("id") != F.col("other")))
    whole = more[0]
    for part in more[1:]:
        whole = whole.unionByName(part)
    return _ranked(whole, k)


def store(df: DataFrame, path: str, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> None:
    """Write unit vectors (id, v and other columns) below ``path``, with the pivots and radii.  Near cells lie together in a
    folder, a pack of ``block_rows`` members or a 64th of all, in files of about ``block_rows`` sorted by cell; so the files
    grow with the rows and not with the cells.  Zero vectors lie in cell and pack -1."""
    spark = df.sparkSession
    df = staged(df, "members")
    squares = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    some, zero = df.where(squares > 0), df.where(squares == 0)
    centres = pivots(some, cell_rows)
    placed = zero.withColumn("cell", F.lit(-1)).withColumn("far", F.lit(0.0))
    zeros, radius, size = zero.count(), np.zeros(0), np.zeros(0, dtype=np.int64)
    if len(centres):
        dealt = staged(celled(some, centres), "cells")
        radius, size = _reach(dealt, len(centres))
        placed = placed.unionByName(dealt)
    packs = _packed(centres, size, max(block_rows, math.ceil(int(size.sum()) / FOLDERS)))
    members = np.bincount(packs, size) if len(packs) else size
    known = [(c, int(p), float(radius[c]), int(size[c]), int(members[p]), centres[c].tolist()) for c, p in enumerate(packs) if size[c]]
    known += [(-1, -1, 0.0, zeros, zeros, None)] if zeros else []
    cells = spark.createDataFrame(known, "cell int, pack int, radius double, n long, members long, pivot array<double>")  # a row for each cell
    blocks = F.ceil(F.col("members") / block_rows)
    placed = placed.join(F.broadcast(cells.select("cell", "pack", blocks.alias("__blocks"))), "cell")
    placed = placed.repartition("pack", F.pmod(F.xxhash64("id"), F.col("__blocks"))).drop("__blocks")
    placed.sortWithinPartitions("pack", "cell").write.partitionBy("pack").parquet(f"{path}/vectors")
    cells.drop("members").coalesce(1).write.parquet(f"{path}/cells")


def stored_search(
    spark: SparkSession, path: str, query: list[float], limit: int = 30, min_score: float | None = None, without: int | None = None, version: int | None = None, report: dict | None = None
) -> DataFrame:
    """The stored vectors of largest cosine with a query: (id, score), ties to the smaller id.

    Cells are read out of their packs' folders: first the nearest ones with enough vectors, then those that may hold as good
    a one.
    ``without`` leaves an id out; ``version`` keeps rows of one version; ``report`` gets the share of the cells that is read.
    """
    cells = spark.read.parquet(f"{path}/cells").collect()  # at most CELLS
    rows = spark.read.parquet(f"{path}/vectors")
    packs = {c["cell"]: c["pack"] for c in cells}
    q = np.array(query, dtype=float)
    size = math.sqrt(q @ q)
    u = q / size if size else q
    away = {c["cell"]: float(np.linalg.norm(u - np.array(c["pivot"]))) if c["pivot"] is not None else math.sqrt(2) for c in cells}
    bound = {c["cell"]: max(away[c["cell"]] - c["radius"], 0.0) for c in cells}
    if not size:
        bound = dict.fromkeys(bound, 0.0)
    wanted = F.array(*[F.lit(float(x)) for x in u])
    score = F.aggregate(F.zip_with("v", wanted, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)

    def hits(some: list[int]) -> DataFrame:
        found = rows.where(F.col("pack").isin(sorted({packs[c] for c in some})) & F.col("cell").isin(some))
        if version is not None:
            found = found.where(F.col("version") == version)
        if without is not None:
            found = found.where(F.col("id") != without)
        found = found.select("id", score.alias("score"))
        return found.where(F.col("score") >= min_score) if min_score is not None else found

    first, n = [], 0
    for c in sorted(cells, key=lambda c: away[c["cell"]]):
        if n <= limit:
            first.append(c["cell"])
            n += c["n"]
    top = hits(first).orderBy(F.desc("score"), "id").limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = top["least"] if top["n"] == limit else (min_score if min_score is not None else -1.0)
    reach = math.sqrt(max(2 - 2 * least, 0.0)) + SLACK
    read = sorted({c["cell"] for c in cells if bound[c["cell"]] <= reach} | set(first))
    if report is not None:
        report["share"] = len(read) / max(len(cells), 1)
    return hits(read).orderBy(F.desc("score"), "id").limit(limit)
