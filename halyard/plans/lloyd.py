"""One pass of centers over a table: the plan that all clusterings share.

Centers (k x d, bounded by the driver's state) are broadcast; every task returns its
partial sums, so nothing but k x d numbers for each task moves, and no row of the table
is shuffled. Small partial sums go to the driver as they are; larger ones are first
merged by cluster in a shuffle, so that the driver gets one row for each cluster however
many tasks there were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halyard.functions.vectors import dense
from halyard.plans import partials
from halyard.plans.nearest import closest

#: Chooses a center for each row: labels and squared distances.
Assign = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Totals:
    """What a pass found."""

    sums: np.ndarray
    counts: np.ndarray
    inertia: float
    labels: int
    evaluated: float


def stamped(x: np.ndarray, label: np.ndarray) -> int:
    """A number that tells whether any of some rows, in whatever order, changes its label: a sum over rows of what a row and its label hash to."""
    odd = (np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    row = (np.ascontiguousarray(x).view(np.uint64) * odd).sum(1, dtype=np.uint64) ^ ((label.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    row = (row ^ (row >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((row ^ (row >> np.uint64(27))).sum(dtype=np.uint64))


def sums_of(x: np.ndarray, assign: Assign, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums and counts by label, the sum of squared distances, and the stamp of all labels, of some rows."""
    sums = np.zeros((k, x.shape[1]))
    if not len(x):
        return sums, np.zeros(k), 0.0, 0
    label, d2 = assign(x)
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
    sums[label[order][first]] = np.add.reduceat(x[order], first, axis=0)
    return sums, np.bincount(label, minlength=k).astype(float), float(d2.sum()), stamped(x, label)


def total(rows: DataFrame | np.ndarray, assign: Assign, k: int, dimensions: int, cost: Callable[[], float] | None = None) -> Totals:
    """``sums_of`` all rows of a table, or of a table that is held in memory."""
    if isinstance(rows, np.ndarray):
        return Totals(*sums_of(rows, assign, k), cost() if cost else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, inertia, labels = np.zeros((k, dimensions)), np.zeros(k), 0.0, 0
        for batch in batches:
            found = sums_of(dense(batch.column(0), dimensions), assign, k)
            sums, counts, inertia, labels = sums + found[0], counts + found[1], inertia + found[2], (labels + found[3]) % 2**64
        told = np.array([inertia, labels % 2**32, labels >> 32, cost() if cost else 0.0])
        hit = np.flatnonzero(counts)
        yield partials.batch(np.r_[-1, hit], np.r_[0, counts[hit]], [told, *sums[hit]])

    parts = rows.select("features").mapInArrow(run, partials.KIND)
    out = Totals(np.zeros((k, dimensions)), np.zeros(k), 0.0, 0, 0.0)
    for r in partials.gathered(parts, k * dimensions * 8):
        values = np.frombuffer(r["sums"])
        if r["cid"] < 0:
            out.inertia += float(values[0])
            out.labels = (out.labels + int(values[1]) + (int(values[2]) << 32)) % 2**64
            out.evaluated += float(values[3])
        else:
            out.sums[r["cid"]] += values
            out.counts[r["cid"]] += r["n"]
    return out


def dense_assign(centers: np.ndarray) -> Assign:
    """Full search; ties go to the smallest center."""
    return lambda x: closest(x, centers)


def inertia_of(rows: DataFrame, centers: np.ndarray, dimensions: int) -> float:
    return total(rows, dense_assign(centers), len(centers), dimensions).inertia
