"""Embedding tables: which vectors take part, and Arrow columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there, has only finite components, and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame, vector: str) -> int:
    """The most frequent length among usable vectors, the longer of equally frequent ones; 0 if there are none."""
    sizes = vectors.where(usable(vector)).groupBy(F.size(vector).alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.zeros((0, 1))
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(whole), -1)
