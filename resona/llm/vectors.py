"""Vectors of an Arrow list column as one NumPy matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(column: str) -> Column:
    """Whether a vector is there and all its entries are numbers: no null, infinity or NaN."""
    x = F.col(column)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each vector, as doubles; vectors of other lengths than the first are an error."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(n) and (n != n[0]).any():
        raise ValueError(f"vectors of {n[0]} and of {n[n != n[0]][0]} entries in one column")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), -1 if len(n) and n[0] else 0)


def integers(x: np.ndarray, scale: int, shift: int = 0) -> np.ndarray:
    """floor(scale * x) + shift; what isn't exact as a double is an error."""
    x = np.floor(x * scale)
    if len(x) and x.size and np.abs(x).max() >= 2**53 - abs(shift):
        raise OverflowError("an entry is too large for an exact integer")
    return x.astype(np.int64) + shift
