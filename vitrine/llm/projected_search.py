"""Operator 9: nearest neighbours through low-dimensional stable projections in kd-trees.

Inner products become distances: the candidates are centred, which changes every score of a query by the same amount, and
lifted by one more dimension to the same length, which the query is given too.  Gaussian (2-stable) projections to a few
dimensions turn the squared distance of two points into itself times a chi-square variable.  Each shard of the
candidates indexes its projections in a kd-tree.  A query takes the leaves in the order of their projected distance, and
from them its projected neighbours one after the other: a point's turn comes when no unread leaf can hold a nearer one.
Its inner product is then verified, until the chi-square test says that a point as near as the k-th best would, with the
wanted confidence, have been projected nearer than the next one.

Queries meet candidates in blocks of bounded size; each block gives its best k, and the best of all blocks are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.vectors import dimension, matrix, usable

#: Candidates and queries that meet in one task.
SHARD_ROWS, QUERY_ROWS = 16384, 4096

#: Leaves read (each time twice as many, so that a query which prunes little takes few steps and one which prunes much
#: reads little), and projected neighbours verified, before the test is made again.
LEAVES, PORTION = 16, 256


def chi_square_quantile(p: float, freedom: int) -> float:
    """The p-quantile of the chi-square distribution with an even number of degrees of freedom, by halving."""
    if freedom % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class KDTree:
    """A kd-tree over points: the rows in the order of its leaves, which hold at most ``leaf`` rows each (more of equal
    points), and the leaves' spans and bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(points))
        self.leaf_span: list[tuple[int, int]] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = [(0, len(points))]
        while waiting:
            start, stop = waiting.pop()
            rows = points[self.order[start:stop]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            widest = int((high - low).argmax())
            if stop - start > leaf and high[widest] > low[widest]:
                half = (stop - start) // 2
                self.order[start:stop] = self.order[start:stop][np.argpartition(rows[:, widest], half)]
                waiting += [(start + half, stop), (start, start + half)]
            else:
                self.leaf_span.append((start, stop))
                boxes.append((low, high))
        self.leaf_low, self.leaf_high = (np.array(x) for x in zip(*boxes))

    def leaves(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the leaves, squared distances of their boxes), the nearest first."""
        gap = np.maximum(np.maximum(self.leaf_low - query, query - self.leaf_high), 0)
        distance = (gap * gap).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        return order, distance[order]


def _power(largest: float) -> int:
    """The power of two to divide by where a component is so large or small that squares would overflow or vanish, else 0."""
    power = math.frexp(largest)[1]
    return power if abs(power) > 300 else 0


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, neighbours joined."""
    out: list[tuple[int, int]] = []
    for start, stop in spans:
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


class Shard:
    """The candidates of one task: their projections in a kd-tree, and how to search them.  ``centre`` and ``top`` are the
    mean of all candidates and the largest squared distance from it."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, centre: np.ndarray, top: float, dims: int, confidence: float, seed: int):
        self.centre, self.top = centre, top
        self.project = np.random.default_rng(seed).standard_normal((points.shape[1] + 1, dims))
        moved = points - centre
        lift = np.sqrt(np.maximum(top - (moved * moved).sum(axis=1), 0))
        places = np.column_stack([moved, lift]) @ self.project
        self.tree = KDTree(places)
        # in the order of the leaves, so that a leaf is one slice
        self.ids, self.points, self.places = ids[self.tree.order], points[self.tree.order], places[self.tree.order]
        self.half = (self.places * self.places).sum(axis=1) / 2
        self.stop_at = chi_square_quantile(confidence, dims)
        self.longest, self.verified = math.sqrt((points * points).sum(axis=1).max()), 0

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best ``k`` found for a query, itself left out."""
        power = _power(float(np.abs(query).max()))
        query = np.ldexp(query, -power)
        scale = math.sqrt(self.top / float(query @ query))
        place, offset = scale * query @ self.project[:-1], float(query @ self.centre)
        leaves, boxes = self.tree.leaves(place)
        slack = 1e-12 * self.longest * math.sqrt(float(query @ query))  # rounding must not break ties
        scores, rows, limit, at, step = np.zeros(0), np.zeros(0, dtype=np.int64), np.inf, 0, LEAVES
        waiting, distance = np.zeros(0, dtype=np.int64), np.zeros(0)
        square = float(place @ place)
        while at < len(leaves) and boxes[at] <= limit or len(distance) and distance.min() <= limit:
            spans = [self.tree.leaf_span[i] for i in np.sort(leaves[at : at + step])]
            if spans:
                gaps = [self.half[a:b] - self.places[a:b] @ place for a, b in _joined(spans)]
                new = np.concatenate([np.arange(a, b) for a, b in _joined(spans)])
                gap = np.maximum(2 * np.concatenate(gaps) + square, 0.0)
                near = np.flatnonzero((gap <= limit) & (self.ids[new] != own))
                waiting, distance = np.append(waiting, new[near]), np.append(distance, gap[near])
                at, step = at + len(spans), 2 * step
            bound = boxes[at] if at < len(leaves) else np.inf
            ready = np.flatnonzero(distance <= min(bound, limit))
            ready = ready[np.argsort(distance[ready])]
            for lo in range(0, len(ready), PORTION):
                if distance[ready[lo]] > limit:
                    break
                some = np.sort(waiting[ready[lo : lo + PORTION]])
                self.verified += len(some)
                scores, rows = np.append(scores, self.points[some] @ query), np.append(rows, some)
                if len(rows) >= k:
                    worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                    keep = scores >= worst - slack
                    scores, rows = scores[keep], rows[keep]
                    limit = self.stop_at * max(2 * self.top - 2 * scale * (worst - offset), 0.0)
            left = np.flatnonzero((distance > bound) & (distance <= limit))
            waiting, distance = waiting[left], distance[left]
        exact = (self.points[rows] * query).sum(axis=1)  # row by row, so that equal vectors tie exactly
        first = np.lexsort((self.ids[rows], -exact))[:k]
        with np.errstate(over="ignore"):
            return self.ids[rows[first]], np.ldexp(exact[first], power)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    dims: int = 24,
    confidence: float = 0.92,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """For every query the ``k`` candidates of largest inner product that were found: (query_id, rank, vec_id, score).

    Both tables have an id and a vector column; a candidate with the query's id is not its neighbour.  Vectors that are
    null, zero, hold null or non-finite components, or are not as long as most, take no part; rows with a null id
    neither.  Queries with the same id count once.  Ties go to the smaller id, and fewer than ``k`` candidates are all
    returned.  ``confidence`` is that of the chi-square test: higher verifies more points.  Scores are exact inner
    products in double precision.  Empty tables give no rows.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    size = dimension(clean, "v")
    clean = clean.where(usable("v") & (F.size("v") == size) & F.col("id").isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = asked.where(usable("v") & (F.size("v") == size) & F.col("id").isNotNull()).dropDuplicates(["id"])
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    averages = [F.avg(F.get("v", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(size)]
    means = clean.agg(F.count("*").alias("n"), largest.alias("largest"), *averages).first()
    power = _power(means["largest"] or 1.0)
    if power:  # dividing by a power of two changes no digit
        half, rest = 2.0 ** -(power // 2), 2.0 ** -(power - power // 2)
        clean = clean.withColumn("v", F.transform("v", lambda x: x.cast("double") * half * rest))
        means = clean.agg(F.count("*").alias("n"), *averages).first()
    n, centre = means["n"], np.array([means[f"m{i}"] or 0.0 for i in range(size)])
    apart = F.zip_with("v", F.array(*[F.lit(float(x)) for x in centre]).cast("array<double>"), lambda x, m: x.cast("double") - m)
    square = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)
    top = clean.agg(F.max(square).alias("top")).first()["top"] or 0.0
    n_queries = asked.count()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n_queries / QUERY_ROWS))
    lots = lambda n: F.array(*[F.lit(i) for i in range(n)]) if n <= 100 else F.sequence(F.lit(0), F.lit(n - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = clean.select(deal(shards).alias("shard"), F.explode(lots(blocks)).alias("block"), "id", "v")
    right = asked.select(F.explode(lots(shards)).alias("shard"), deal(blocks).alias("block"), "id", "v")

    def run(points: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if points.num_rows and wanted.num_rows:
            shard = Shard(points["id"].to_numpy(), matrix(points["v"]), centre, top, dims, confidence, seed)
            for own, query in zip(wanted["id"].to_pylist(), matrix(wanted["v"])):
                found, scores = shard.best(own, query, k)
                with np.errstate(over="ignore"):
                    scores = np.ldexp(scores, power)
                for held, values in zip(out, ([own] * len(found), found.tolist(), scores.tolist())):
                    held.extend(values)
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["query_id", "vec_id", "score"])

    pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = pairs.applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
