"""Operator 7: regularised quadratic discriminant analysis of document statistics.

Each text becomes a few statistics of its bytes, words and lines, transformed by logarithms so that they are roughly
normal within a class.  Spark adds up the classes' first and second moments over all labelled rows; their covariances
are shrunk towards the pooled one and towards its diagonal; a score is the logistic of the difference between the two
log densities, computed from Mahalanobis distances with Cholesky factors that are made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vitrine.llm.common import whole_text, written

STATISTICS = (
    "log_bytes", "upper", "digit", "space", "line_end", "stop", "symbol", "wide",
    "word_length", "distinct_words", "repeated_word", "distinct_lines", "common_byte", "entropy",
)

#: Byte classes: other, lower case, upper case, digit, blank, line end, sentence mark, symbol, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[128:] = 8


def _log_odds(part: float, whole: float) -> float:
    """Logarithm of the odds of a share, with half a count added to both sides."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; an empty text gives those of no bytes, words and lines."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    histogram = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=histogram, minlength=9)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    shares = histogram[histogram > 0] / max(n, 1)
    same = sum(map(eq, words, words[1:]))
    return [
        float(np.log1p(n)),
        *(_log_odds(kinds[k], n) for k in (2, 3, 4, 5, 6, 7, 8)),
        float(np.log1p((n - kinds[4] - kinds[5]) / max(len(words), 1))),
        float(np.log1p(len(set(words))) / np.log1p(max(len(words), 1))),
        _log_odds(same, max(len(words) - 1, 0)),
        float(np.log1p(len(set(lines))) / np.log1p(max(len(lines), 1))),
        _log_odds(histogram.max(), n),
        float(-(shares * np.log(shares)).sum()) if n else 0.0,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>) of every whole text; one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=[id_col, "stats"])

    kept = docs.select(F.col(id_col), whole_text(text_col).alias("__text"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, stats array<double>")


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log determinants of both classes, and the log odds of class 1."""

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, whiten, log_det in zip(self.means, self.whiten, self.log_det):
            z = (x - mean) @ whiten.T
            density.append(-0.5 * ((z * z).sum(axis=1) + log_det))
        odds = np.clip(density[1] - density[0] + self.prior, -700, 700) if density else np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-odds))


def fit(labelled: DataFrame, label_col: str, shrink: float = 0.5, ridge: float = 0.01) -> Discriminant:
    """Fit on all rows of ``labelled`` (stats, label 0 or 1).

    ``shrink`` is the weight of the pooled covariance in each class's, ``ridge`` that of the diagonal; the defaults come
    from cross-validation within training rows.  Where a class
    has fewer than two rows there is no model and every score is the smoothed share of class 1.
    """
    d = len(STATISTICS)
    x = [F.col("stats")[i] for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    squares = [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {r["label"]: r for r in labelled.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"), *sums, *squares).collect()}
    n = [rows[k]["n"] if k in rows else 0 for k in (0, 1)]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return Discriminant([], [], [], prior)
    means, covariances = [], []
    for k in (0, 1):
        mean = np.array([rows[k][f"s{i}"] for i in range(d)]) / n[k]
        square = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                square[i, j] = square[j, i] = rows[k][f"q{i}_{j}"] / n[k]
        means.append(mean)
        covariances.append(square - np.outer(mean, mean))
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / sum(n)
    whiten, log_det = [], []
    for covariance in covariances:
        mixed = (1 - shrink) * covariance + shrink * pooled
        mixed = (1 - ridge) * mixed + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(means, whiten, log_det, prior)


def scored(stats: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of rows with statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
                yield pa.record_batch([batch.column(0), pa.array(model.score(x))], names=[id_col, "score"])

    kept = stats.select(id_col, "stats")
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, score double")


def training_rows(stats: DataFrame, labels: DataFrame, learn, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Statistics with their label, of rows for which ``learn`` holds.  Labels that are null or not 0 or 1 are left out;
    an id with several labels takes the largest; null ids have no label."""
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    return stats.where(learn).join(one, id_col).select("stats", "label")


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``.

    The model is fitted on the labelled rows for which ``learn`` holds.  Statistics are computed once and staged beside
    the rows, so that every row is kept or dropped by its own text, whatever its id.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    source = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), every)
    schema = StructType([source.schema["id"], source.schema["doc"], StructField("stats", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.list_(pa.float64()))], names=["id", "doc", "stats"])

    staged, _ = written(source.mapInArrow(run, schema), "with-statistics")
    model = fit(training_rows(staged.withColumnRenamed("id", id_col).select(id_col, "stats"), labels, learn, id_col=id_col), "label")

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy())) if len(stats) else [], dtype=float)

    return staged.where(score("stats") >= threshold).select("doc.*")
