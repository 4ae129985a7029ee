"""Embeddings as integer vectors, for the exact vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components beyond this are taken as this, so that products of 64 of them fit a long.
LIMIT = 1 << 27


def finite(column: str) -> Column:
    """True for a vector that is there and has neither null nor non-finite components."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~odd, F.lit(False))


def scaled(column: str, scale: int) -> Column:
    """Every component as ``floor(scale * component)``, the component as a double."""
    return F.transform(column, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(
        x.cast("double") * F.lit(float(scale))))).cast("int"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of one length (``width``; shorter ones are filled with zeros) as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if width is None or len(flat) == len(column) * width:
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, width or 0)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def float_exact(*parts: np.ndarray) -> bool:
    """Whether sums of products of these integers (or of their differences) along a row are exact in doubles."""
    return all(not p.size or (p.shape[-1] <= 128 and np.abs(p).max() <= 1 << 22) for p in parts)
