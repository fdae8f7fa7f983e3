"""Columns of vectors as numpy matrices, and which of their rows are usable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, vector: str = "embedding"):
    """True for vectors that are neither null, empty nor zero and hold no null or non-finite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(table: DataFrame, vector: str = "embedding") -> list[int]:
    """The lengths of the usable vectors, in order; a row for each length reaches the driver."""
    return sorted(r["n"] for r in table.where(usable(table, vector)).select(F.size(vector).alias("n")).distinct().collect())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, all of length dim, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a list column without nulls, for each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, matrix(column.take(pa.array(at)), int(dim))
