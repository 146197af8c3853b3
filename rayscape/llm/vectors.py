"""Vectors in Arrow batches: which rows take part, and their components as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """A vector that isn't null or empty, with finite components only."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal sizes, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_size(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as a matrix) of each size of vectors in a column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    every = ((np.flatnonzero(sizes == n)) for n in np.unique(sizes))
    return [(at, matrix(column.take(pa.array(at)))) for at in every]


def units(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by a power of two first, so that no square leaves the range of doubles."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None]) if v.size else v
    return v / np.linalg.norm(v, axis=1)[:, None]
