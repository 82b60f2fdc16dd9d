"""Vector columns: arithmetic as Column expressions, and Arrow batches as matrices."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.config import get_tuning


def vector(df: DataFrame, features: str | list[str]) -> Column:
    """ARRAY<DOUBLE> from an array column, a Spark ML vector, or numeric columns."""
    if not isinstance(features, str):
        return F.array(*[F.col(c).cast("double") for c in features])
    kind = df.schema[features].dataType
    if isinstance(kind, T.ArrayType):
        return F.col(features).cast("array<double>")
    if kind.typeName() == "vector" or type(kind).__name__ == "VectorUDT":
        from pyspark.ml.functions import vector_to_array

        return vector_to_array(F.col(features), "float64")
    return F.array(F.col(features).cast("double"))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def dot(x: Column, weights: np.ndarray) -> Column:
    """Inner product with a constant vector; unrolled into generated code while short."""
    if len(weights) <= get_tuning().unrolled_dimensions:
        return _sum([x[i] * F.lit(float(w)) for i, w in enumerate(weights)])
    constant = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(x, constant, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def squared_distance(x: Column, y: Column, dimensions: int) -> Column:
    """Sum of squared differences."""
    if dimensions <= get_tuning().unrolled_dimensions:
        return _sum([(x[i] - y[i]) * (x[i] - y[i]) for i in range(dimensions)])
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def squared_norm(x: Column, dimensions: int) -> Column:
    if dimensions <= get_tuning().unrolled_dimensions:
        return _sum([x[i] * x[i] for i in range(dimensions)])
    return F.aggregate(F.transform(x, lambda a: a * a), F.lit(0.0), lambda s, v: s + v)


def dense(column: pa.Array, dimensions: int) -> np.ndarray:
    """A checked vector column of an Arrow batch as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), float).reshape(-1, dimensions)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows, float).ravel()))
