"""Vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: str = "embedding", empty: bool = False) -> Column:
    """Not null, not empty unless ``empty``, and without null or non-finite components."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) >= (0 if empty else 1)) & ~bad, F.lit(False))


def matrix(arr, dim: int = 0) -> np.ndarray:
    """float64 rows of an Arrow list array without nulls; shorter vectors are filled with zeros."""
    import pyarrow as pa

    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks != 1 else arr.chunk(0)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.diff(arr.offsets.to_numpy(zero_copy_only=False))
    width = max(dim, int(lens.max()) if len(lens) else 0)
    if len(lens) and (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width))
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out
