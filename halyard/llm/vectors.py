"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of finite components, and these as doubles, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = column.flatten()
    flat = np.asarray(values.cast(pa.float64()).fill_null(float("nan")))
    row = np.repeat(np.arange(len(size)), size)
    ok = np.asarray(column.is_valid()) & (np.bincount(row, ~np.isfinite(flat), len(size)) == 0)
    width = int(size[ok].max(initial=0))
    out = np.zeros((len(size), width))
    good = ok[row]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[good], place[good]] = flat[good]
    rows = np.flatnonzero(ok)
    return rows, out[rows]


def padded(x: np.ndarray, width: int) -> np.ndarray:
    """A matrix with at least ``width`` columns."""
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
