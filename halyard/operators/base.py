"""What estimators share: fitted state, parameters, saving and loading, and the record of what ran."""

from __future__ import annotations

import inspect
import json
from typing import Any, Self

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from halyard.diagnostics import BackendEvent, record_event
from halyard.errors import BackendError, NotFitted


class Estimator:
    """Parameters are set once, by name; ``fit`` is a function of them and its input alone."""

    execution_backend_: str

    def get_params(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in inspect.signature(type(self).__init__).parameters if name != "self"}

    def set_params(self, **values: Any) -> Self:
        for name, value in values.items():
            if name not in self.get_params():
                raise ValueError(f"{type(self).__name__} has no parameter {name!r}")
            setattr(self, name, value)
        return self

    def clone(self) -> Self:
        """An unfitted estimator with the same parameters."""
        return type(self)(**self.get_params())

    def _need(self, attribute: str) -> None:
        if not hasattr(self, attribute):
            raise NotFitted(f"this {type(self).__name__} is not fitted yet; call fit first")

    def _ran(self, operation: str, backend: str, reason: str = "", shape: tuple[int, ...] = ()) -> None:
        if operation == "fit":
            self.execution_backend_ = backend
        record_event(BackendEvent(type(self).__name__, operation, backend, reason, shape=shape))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"

    #: Fitted tables, saved as Parquet; all other fitted values are saved as JSON.
    _tables: tuple[str, ...] = ()

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters and fitted values, as JSON and Parquet, in any store that Spark writes."""
        def plain(value: Any) -> Any:
            if isinstance(value, np.ndarray):
                return {"__array__": value.tolist(), "dtype": str(value.dtype), "shape": value.shape}
            if isinstance(value, np.generic):
                return value.item()
            if isinstance(value, dict):
                return {k: plain(v) for k, v in value.items()}
            return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value

        state = {k: plain(v) for k, v in vars(self).items() if not isinstance(v, DataFrame) and not k.startswith("__") and k not in self.get_params()}
        params = {k: plain(v) for k, v in self.get_params().items() if not isinstance(v, DataFrame)}
        spark.createDataFrame([(json.dumps({"params": params, "state": state}),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        for name in self._tables:
            if hasattr(self, name):
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Self:
        """The estimator that ``save`` wrote."""
        def rich(value: Any) -> Any:
            if isinstance(value, dict) and "__array__" in value:
                return np.array(value["__array__"], value["dtype"]).reshape(value["shape"])
            if isinstance(value, dict):
                return {k: rich(v) for k, v in value.items()}
            return [rich(v) for v in value] if isinstance(value, list) else value

        saved = json.loads(spark.read.parquet(f"{path}/model").first()[0])
        model = cls(**rich(saved["params"]))
        for k, v in saved["state"].items():
            setattr(model, k, rich(v))
        for name in cls._tables:
            try:
                setattr(model, name, spark.read.parquet(f"{path}/{name}"))
            except PySparkException as error:
                raise BackendError(f"{path} lacks the table {name}") from error
        return model


def sorted_labels(df: DataFrame) -> list:
    """The different labels in ascending order."""
    return sorted(r[0] for r in df.select("label").distinct().collect())
