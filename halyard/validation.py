"""Checks of parameters and of training tables; a table is checked by one aggregate."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from numbers import Integral, Real

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.errors import SparseInput, UnsupportedInput, UnsupportedParameter
from halyard.functions.vectors import vector


@dataclass(frozen=True)
class Shape:
    """Rows and dimensions of a checked table."""

    rows: int
    dimensions: int


def require_params(estimator: str, **checks: tuple[object, Iterable]) -> None:
    """Refuses values that are not among the served ones; none is silently ignored."""
    for name, (value, served) in checks.items():
        if value not in tuple(served):
            raise UnsupportedParameter(f"{estimator}: {name}={value!r} is not supported; use one of {', '.join(map(repr, served))}")


def require_int(name: str, value: object, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, Integral) or value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be an integer of at least {low}" + (f" and at most {high}" if high is not None else "") + f"; got {value!r}")
    return int(value)


def require_positive(name: str, value: object, infinite: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, Real) or math.isnan(value) or value <= 0 or (math.isinf(value) and not infinite):
        raise ValueError(f"{name} must be a positive number; got {value!r}")
    return float(value)


def prepared(df: DataFrame, id_col: str | None, features: str | list[str], label: str | None = None, weight: str | None = None) -> DataFrame:
    """id, features (ARRAY<DOUBLE>), and label and weight where named."""
    if isinstance(features, str) and type(df.schema[features].dataType).__name__ == "VectorUDT" and df.select(F.col(features)).limit(1).collect():
        first = df.select(features).first()[0]
        if type(first).__name__ == "SparseVector":
            raise SparseInput("sparse vectors are not served; make them dense first")
    columns = [F.col(id_col).alias("id")] if id_col else []
    columns.append(vector(df, features).alias("features"))
    if label is not None:
        if isinstance(df.schema[label].dataType, (T.ArrayType, T.StructType, T.MapType)):
            raise UnsupportedInput("labels of several outputs are not served")
        columns.append(F.col(label).alias("label"))
    if weight is not None:
        columns.append(F.col(weight).cast("double").alias("weight"))
    return df.select(*columns)


def checked(df: DataFrame, what: str = "X", dimensions: int | None = None, empty: bool = False) -> Shape:
    """Rows and dimensions of a prepared table; null, NaN, infinite or ragged vectors are errors."""
    bad = F.col("features").isNull() | F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sizes = [F.count("*").alias("n"), F.sum(bad.cast("long")).alias("bad"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high")]
    if "id" in df.columns:
        sizes.append(F.sum(F.col("id").isNull().cast("long")).alias("no_id"))
    if "weight" in df.columns:
        sizes.append(F.sum((F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf"))).cast("long")).alias("bad_weight"))
    if "label" in df.columns:
        sizes.append(F.sum(F.col("label").isNull().cast("long")).alias("no_label"))
    r = df.agg(*sizes).first().asDict()
    if not r["n"]:
        if empty:
            return Shape(0, dimensions or 0)
        raise ValueError(f"{what} has no rows")
    if r["bad"]:
        raise ValueError(f"{what} contains null, NaN or infinity in {r['bad']} rows")
    if r["low"] != r["high"] or r["low"] < 1:
        raise ValueError(f"{what} has vectors of {r['low']} to {r['high']} components")
    if dimensions is not None and r["low"] != dimensions:
        raise ValueError(f"{what} has {r['low']} features, but {dimensions} were fitted")
    for key, text in (("no_id", "a null id"), ("bad_weight", "a weight that is null, negative or not finite"), ("no_label", "a null label")):
        if r.get(key):
            raise ValueError(f"{what} has rows with {text}")
    return Shape(r["n"], r["low"])
