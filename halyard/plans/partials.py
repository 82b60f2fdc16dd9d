"""Partial sums of tasks, merged.

Tasks emit rows (cid, n, sums): a slot, a count, and the bytes of a vector of doubles.
Few bytes go straight to the driver. More are first merged by slot in a shuffle, so the
driver gets one row for each slot, however many tasks there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

KIND = "cid long, n double, sums binary"
#: Bytes of a task's partial sums up to which they go straight to the driver.
DIRECT = 1 << 18


def batch(cid: np.ndarray, n: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of KIND."""
    return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(n, pa.float64()), pa.array([s.tobytes() for s in sums], pa.binary())], ["cid", "n", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for part in batches:
        for c, n, v in zip(*(x.to_pylist() for x in part.columns), strict=True):
            if c in held:
                held[c][0] += n
                held[c][1] += np.frombuffer(v)
            else:
                held[c] = [n, np.frombuffer(v).copy()]
    for c, (n, v) in held.items():
        yield batch([c], [n], [v])


def gathered(parts: DataFrame, size: int) -> list[Row]:
    """Rows to be added up on the driver; ``size`` is the most bytes that one task emits."""
    if size > DIRECT:
        parts = parts.repartition("cid").mapInArrow(_merge, KIND)
    return parts.collect()
