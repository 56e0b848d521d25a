"""Integer vectors from a column of floating-point ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Components beyond this make sums of products of two vectors leave 64 bits.
LARGEST = 2.0**50


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def scaled(scale: int, vector: str = "embedding") -> Column:
    """floor(scale * x) of each component, the product taken in double precision."""

    def whole(x):
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x) * scale <= LARGEST, y).otherwise(
            F.raise_error(F.lit("a component is too large for 64-bit arithmetic")).cast("long")
        )

    return F.transform(vector, whole)


def shape(rows: DataFrame, vector: str) -> tuple[int, int, int]:
    """Number of rows, the longest vector's size and the largest absolute component."""
    most = F.array_max(F.transform(vector, F.abs))
    row = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("size"), F.max(most).alias("most")).first()
    return row.n, row["size"] or 0, row.most or 0


def padded(vector: str, size: int) -> Column:
    """Vectors of one size: zeros follow where components are missing."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), size - F.size(vector))))


def matrix(column, size: int) -> np.ndarray:
    """An Arrow column of equally long lists as an array of rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)
