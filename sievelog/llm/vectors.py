"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not empty, without null or non-finite components, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of all rows with a usable vector and an id."""
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))


def matrix(column) -> np.ndarray:
    """A list column whose lists are equally long, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def normed(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that neither tiny nor huge rows leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision. Sums run from left to right, so equal rows give equal results."""
    scale_a, scale_b = (np.where((m := np.abs(x).max(axis=1, keepdims=True)) < 1e100, np.where(m > 1e-100, 1.0, m), m) for x in (a, b))
    a, b = a / scale_a, b / scale_b
    total = [np.add.accumulate(x, axis=1)[:, -1] for x in (a * b, a * a, b * b)]
    return np.clip(total[0] / np.sqrt(total[1] * total[2]), -1.0, 1.0)
