"""L2-penalised logistic regression, with a certificate.

The objective is the weighted mean loss plus |W|^2 / (2 C S), S being the sum of
weights; intercepts are free. Two classes have one weight vector, for the larger
label; more classes are multinomial. A table of checked small size is fitted in
memory, any other by Spark ML; a pass over the data then measures the gradient of that objective at the result, in original
coordinates, and a warning tells if it is not below ``tol``. If it is not, Newton
steps on aggregated second derivatives polish two-class fits of few features.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from typing import Self

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression as _SparkLogistic
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.config import get_config
from halyard.diagnostics import BackendEvent, record_event
from halyard.errors import ConvergenceWarning, UnsupportedParameter
from halyard.functions.vectors import dot, lists, vector
from halyard.operators.base import Estimator, sorted_labels
from halyard.plans import partials
from halyard.plans.nearest import fits, mapped
from halyard.validation import checked, prepared, require_int, require_params, require_positive

#: Features up to which Newton steps are taken; coefficients up to which scores are unrolled into generated code.
NEWTON, UNROLLED = 256, 128
#: Numbers of a long sum that are merged as one row; passes of one Newton step at most.
SLICE, CONJUGATE = 8192, 50


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss of each row given raw scores [row, class] (one column: two classes)."""
    if z.shape[1] == 1:
        s = np.where(y == 1, -z[:, 0], z[:, 0])
        return np.logaddexp(0, s)
    top = z.max(1)
    return np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]


def _residuals(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    if z.shape[1] == 1:
        return 0.5 * (1 + np.tanh(0.5 * z)) - (y == 1)[:, None]
    r = _softmax(z)
    r[np.arange(len(y)), y] -= 1
    return r


class LogisticRegression(Estimator):
    """Fits and scores; see the module for the objective."""

    def __init__(
        self, penalty: str | None = "l2", dual: bool = False, tol: float = 1e-4, C: float = 1.0, fit_intercept: bool = True, intercept_scaling: float = 1, class_weight: dict | str | None = None, random_state: int | None = None,
        solver: str = "lbfgs", max_iter: int = 100, multi_class: str = "auto", verbose: int = 0, warm_start: bool = False, n_jobs: int | None = None, l1_ratio: float | None = None,
    ) -> None:
        self.penalty, self.dual, self.tol, self.C, self.fit_intercept, self.intercept_scaling = penalty, dual, tol, C, fit_intercept, intercept_scaling
        self.class_weight, self.random_state, self.solver, self.max_iter, self.multi_class = class_weight, random_state, solver, max_iter, multi_class
        self.verbose, self.warm_start, self.n_jobs, self.l1_ratio = verbose, warm_start, n_jobs, l1_ratio

    def _falls_back(self) -> bool:
        """Whether settings let Spark ML serve an L1 or elastic-net penalty, which is refused else."""
        return self.penalty in ("l1", "elasticnet") and get_config().fallback_policy != "error"

    def _check(self) -> None:
        if self._falls_back():
            return
        require_params("LogisticRegression", penalty=(self.penalty, ("l2", None)), dual=(self.dual, (False,)), solver=(self.solver, ("lbfgs",)), warm_start=(self.warm_start, (False,)), intercept_scaling=(self.intercept_scaling, (1,)), multi_class=(self.multi_class, ("auto", "multinomial")), l1_ratio=(self.l1_ratio, (None, 0, 0.0)))
        require_positive("C", self.C, infinite=True)
        require_positive("tol", self.tol)
        require_int("max_iter", self.max_iter, 1)

    def _penalty(self, total: float) -> float:
        return 0.0 if self.penalty is None or math.isinf(self.C) else 1.0 / (self.C * total)

    def fit(self, df: DataFrame, label: str = "label", features: str | list[str] = "features", weight: str | None = None) -> Self:
        self._check()
        rows = prepared(df, None, features, label, weight)
        if weight is None:
            rows = rows.withColumn("weight", F.lit(1.0))
        rows = rows.persist()
        try:
            shape = checked(rows)
            self._rows, self.n_features_in_, self._features = shape.rows, shape.dimensions, features
            self.classes_ = sorted_labels(rows)
            if len(self.classes_) < 2:
                raise ValueError(f"This solver needs samples of at least 2 classes in the data, but the data contains only one class: {self.classes_[0]!r}")
            # labels as codes in ascending order
            code = F.array_position(F.array(*[F.lit(c) for c in self.classes_]), F.col("label")).cast("int") - 1
            coded = rows.select("features", code.alias("code"), "weight")
            sums = {r["code"]: r["w"] for r in coded.groupBy("code").agg(F.sum("weight").alias("w")).collect()}
            factors = self._class_factors(sums)
            if any(f != 1 for f in factors.values()):
                by_class = F.array(*[F.lit(float(factors[i])) for i in range(len(self.classes_))])
                coded = coded.withColumn("weight", F.col("weight") * by_class[F.col("code")])
            total = sum(sums.get(i, 0.0) * factors[i] for i in range(len(self.classes_)))
            if total <= 0:
                raise ValueError("the sum of weights must be positive")
            self.sum_weights_ = total
            if self._falls_back():
                share = 1.0 if self.penalty == "l1" else float(self.l1_ratio or 0.0)
                self._keep(_spark_fit(coded, len(self.classes_), 1 / (self.C * total), share, self.tol, self.max_iter, self.fit_intercept))
                self.execution_backend_ = "spark_ml"
                record_event(BackendEvent("LogisticRegression", "fit", "spark_ml", f"penalty={self.penalty!r}", fallback=True))
            else:
                self._solve(coded, len(self.classes_), total)
            self.center_ = _partials(coded, lambda x, y, w: x.sum(0), shape.dimensions) / shape.rows
            #: the intercept in coordinates centred on the mean row
            self.centered_intercept_ = self.intercept_ + self.coef_ @ self.center_
        finally:
            rows.unpersist()
        return self

    def _class_factors(self, sums: dict[int, float]) -> dict[int, float]:
        k = len(self.classes_)
        if self.class_weight is None:
            return dict.fromkeys(range(k), 1.0)
        if self.class_weight == "balanced":
            total = sum(sums.values())
            return {i: total / (k * sums[i]) if sums.get(i) else 0.0 for i in range(k)}
        if isinstance(self.class_weight, dict):
            if unknown := set(self.class_weight) - set(self.classes_):
                raise ValueError(f"class_weight names classes that do not occur: {sorted(unknown)}")
            return {i: float(self.class_weight.get(c, 1.0)) for i, c in enumerate(self.classes_)}
        raise UnsupportedParameter(f"class_weight must be None, 'balanced' or a dict; got {self.class_weight!r}")

    def _solve(self, coded: DataFrame, k: int, total: float) -> None:
        penalty = self._penalty(total)
        outputs, d = 1 if k == 2 else k, self.n_features_in_
        if fits(self._rows, d + 1):
            fun = _in_memory(coded, d, outputs, total, penalty, self.fit_intercept)
            found, self.n_iter_ = minimize(fun, np.zeros(outputs * d + outputs * self.fit_intercept), self.tol / 10, self.max_iter)
            self.coef_ = found[: outputs * d].reshape(outputs, d)
            self.intercept_ = found[outputs * d :] if self.fit_intercept else np.zeros(outputs)
            value, slope, gradient = _evaluate(coded, self.coef_, self.intercept_, total, penalty, self.fit_intercept)
            backend = "memory"
        else:
            value, slope, gradient, backend = self._solve_distributed(coded, k, total, penalty)
        dense = k == 2 and d <= NEWTON
        enough = min(self.tol, 1e-8) if dense else self.tol
        for _ in range(25 if dense else min(25, self.max_iter - self.n_iter_)):
            if gradient <= enough:
                break
            if dense:
                step = np.linalg.lstsq(_curvature(coded, self.coef_[0], self.intercept_[0], total, penalty, self.fit_intercept), slope, rcond=None)[0]
            else:
                step = _conjugate(coded, self.coef_, self.intercept_, slope, total, penalty, self.fit_intercept)
            size = 1.0
            while size > 1e-6:
                coef = self.coef_ - size * step[: outputs * d].reshape(outputs, d)
                intercept = self.intercept_ - (size * step[outputs * d :] if self.fit_intercept else 0.0)
                new = _evaluate(coded, coef, intercept, total, penalty, self.fit_intercept)
                if new[0] <= value + 1e-15 * abs(value) and (new[2] < gradient or not dense):
                    break
                size /= 2
            else:
                break
            self.coef_, self.intercept_, (value, slope, gradient), backend = coef, intercept, new, f"{backend.removesuffix('+newton')}+newton"
            self.n_iter_ += 1
        self.objective_, self.gradient_max_ = value, gradient
        self._ran("fit", backend, shape=(self._rows, self.n_features_in_))
        if gradient > self.tol:
            warnings.warn(f"the largest gradient component is {gradient:.3g}, above tol={self.tol:g}, after {self.n_iter_} iterations", ConvergenceWarning, stacklevel=4)

    def _solve_distributed(self, coded: DataFrame, k: int, total: float, penalty: float) -> tuple[float, np.ndarray, float, str]:
        # Spark ML stops by relative improvement; that is tightened until the gradient itself is small
        for closeness in (self.tol * 1e-2, self.tol * 1e-4, 1e-10):
            self._keep(_spark_fit(coded, k, penalty, 0.0, min(closeness, 1e-6), self.max_iter, self.fit_intercept))
            value, slope, gradient = _evaluate(coded, self.coef_, self.intercept_, total, penalty, self.fit_intercept)
            if gradient <= self.tol or self.n_iter_ >= self.max_iter or (k == 2 and self.n_features_in_ <= NEWTON):
                break  # Newton steps do the rest
        return value, slope, gradient, "spark_ml"

    def _keep(self, found) -> None:
        """Coefficients of a Spark ML model."""
        if len(self.classes_) == 2:
            self.coef_, self.intercept_ = np.array([found.coefficients.toArray()]), np.array([found.intercept])
        else:
            self.coef_, self.intercept_ = found.coefficientMatrix.toArray(), found.interceptVector.toArray()
        self.n_iter_ = found.summary.totalIterations

    def objective(self, df: DataFrame, label: str = "label", weight: str | None = None) -> float:
        """The objective at the fitted coefficients on labelled rows."""
        rows = self._coded(df, label, weight)
        total = rows.agg(F.sum("weight")).first()[0]
        return _evaluate(rows, self.coef_, self.intercept_, total, self._penalty(total), self.fit_intercept)[0]

    def duality_gap(self, df: DataFrame, label: str = "label", weight: str | None = None) -> float:
        """Primal minus Fenchel dual of a two-class fit without intercept, or with its dual point centred."""
        rows = self._coded(df, label, weight)
        total = rows.agg(F.sum("weight")).first()[0]
        penalty = self._penalty(total)
        if len(self.classes_) != 2 or not penalty:
            raise UnsupportedParameter("the duality gap is served for two penalised classes")
        primal = _evaluate(rows, self.coef_, self.intercept_, total, penalty, self.fit_intercept)[0]
        raw = dot(F.col("features"), self.coef_[0]) + F.lit(float(self.intercept_[0]))
        signed = F.when(F.col("code") == 1, raw).otherwise(-raw)
        alpha = 1 / (1 + F.exp(signed))
        entropy = F.when((alpha > 0) & (alpha < 1), -(alpha * F.log(alpha) + (1 - alpha) * F.log(1 - alpha))).otherwise(0.0)
        pull = F.when(F.col("code") == 1, alpha).otherwise(-alpha) * F.col("weight")
        sums = rows.agg(F.sum(F.col("weight") * entropy).alias("h"), *[F.sum(pull * F.col("features")[i]).alias(f"s{i}") for i in range(self.n_features_in_)]).first()
        s = np.array([sums[f"s{i}"] for i in range(self.n_features_in_)]) / total
        return primal - (sums["h"] / total - float(s @ s) / (2 * penalty))

    def _coded(self, df: DataFrame, label: str, weight: str | None) -> DataFrame:
        self._need("coef_")
        rows = prepared(df, None, self._features, label, weight)
        checked(rows, dimensions=self.n_features_in_)
        code = F.array_position(F.array(*[F.lit(c) for c in self.classes_]), F.col("label")).cast("int") - 1
        return rows.select("features", code.alias("code"), F.col("weight") if weight else F.lit(1.0).alias("weight"))

    def _scored(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_raw``, the scores: in generated code while there are few terms, else in Arrow batches."""
        self._need("coef_")
        x = vector(df, self._features)
        if self.coef_.size <= UNROLLED:
            return df.withColumn("_raw", F.array(*[dot(x, w) + F.lit(float(b)) for w, b in zip(self.coef_, self.intercept_, strict=True)]))
        coef, intercept = self.coef_, self.intercept_
        named = df.withColumn("_x", x)
        return mapped(named, self.n_features_in_, {"_raw": "array<double>"}, lambda x: [lists(x @ coef.T + intercept)], source="_x").drop("_x")

    def _classes(self) -> Column:
        return F.array(*[F.lit(c) for c in self.classes_])

    def decision_function(self, df: DataFrame) -> DataFrame:
        """``df`` with ``decision``: a number for two classes, else an array."""
        return self._scored(df).withColumn("decision", F.col("_raw")[0] if len(self.classes_) == 2 else F.col("_raw")).drop("_raw")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; a score of zero is the smaller label, equal scores the smallest."""
        code = F.when(F.col("_raw")[0] > 0, 1).otherwise(0) if len(self.classes_) == 2 else F.array_position(F.col("_raw"), F.array_max("_raw")) - 1
        return self._scored(df).withColumn("prediction", self._classes()[code.cast("int")]).drop("_raw")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``: an array in the order of ``classes_``."""
        scored = self._scored(df)
        if len(self.classes_) == 2:
            return scored.withColumn("_p", 1 / (1 + F.exp(-F.col("_raw")[0]))).withColumn("probability", F.array(1 - F.col("_p"), F.col("_p"))).drop("_p", "_raw")
        # step by step, so that scores are not computed again for every class
        e = scored.withColumn("_top", F.array_max("_raw"))
        e = e.withColumn("_e", F.transform("_raw", lambda r: F.exp(r - F.col("_top"))))
        e = e.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda s, v: s + v))
        return e.withColumn("probability", F.transform("_e", lambda v: v / F.col("_sum"))).drop("_raw", "_top", "_e", "_sum")

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with ``log_probability``."""
        found = self.predict_proba(df)
        return found.withColumn("log_probability", F.transform("probability", F.log)).drop("probability")

    def score(self, df: DataFrame, label: str = "label") -> float:
        """Accuracy."""
        return self.predict(df).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]

    def densify(self) -> Self:
        """Coefficients as an array only."""
        self.__dict__.pop("sparse_coef_", None)
        return self

    def sparsify(self) -> Self:
        """Beside the array, ``sparse_coef_``: a sparse vector for every row of coefficients."""
        self._need("coef_")
        self.sparse_coef_ = [Vectors.sparse(len(row), np.flatnonzero(row).tolist(), row[np.flatnonzero(row)].tolist()) for row in self.coef_]
        return self


def minimize(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, tol: float, max_iter: int, memory: int = 10) -> tuple[np.ndarray, int]:
    """Limited-memory BFGS: the point at which no gradient component exceeds ``tol``, or the last one, and the iterations."""
    value, slope = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for iteration in range(max_iter):
        if np.abs(slope).max() <= tol:
            return x, iteration
        way, shares = -slope, []
        for s, y, r in reversed(steps):
            shares.append(r * (s @ way))
            way = way - shares[-1] * y
        if steps:
            s, y, _ = steps[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y, r), share in zip(steps, reversed(shares), strict=True):
            way = way + s * (share - r * (y @ way))
        fall = slope @ way
        if fall >= 0:
            way, fall, steps = -slope, -(slope @ slope), []
        size = 1.0 if steps else min(1.0, 1 / np.abs(slope).sum())
        low, high = 0.0, np.inf
        for _ in range(40):  # bisection for the weak Wolfe conditions
            new, bend = fun(x + size * way)
            if new > value + 1e-4 * size * fall:
                high = size
            elif bend @ way < 0.9 * fall:
                low = size
            else:
                break
            size = (low + high) / 2 if np.isfinite(high) else 2 * size
        if not new <= value + 1e-12 * abs(value):
            return x, iteration
        s, y = size * way, bend - slope
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        x, value, slope = x + s, new, bend
    return x, max_iter


def _in_memory(coded: DataFrame, d: int, k: int, total: float, penalty: float, free: bool) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The objective and its gradient over rows held on the driver; parameters are weights row by row, then intercepts."""
    rows = coded.toArrow().combine_chunks()
    x = np.asarray(rows.column("features").combine_chunks().flatten(), float).reshape(-1, d)
    y, w = rows.column("code").to_numpy(), rows.column("weight").to_numpy()

    def fun(p: np.ndarray) -> tuple[float, np.ndarray]:
        coef = p[: k * d].reshape(k, d)
        z = x @ coef.T + (p[k * d :] if free else 0.0)
        r = _residuals(z, y) * w[:, None] / total
        slope = np.concatenate([(r.T @ x + penalty * coef).ravel(), r.sum(0) if free else []])
        return float(np.sum(w * _losses(z, y)) / total + 0.5 * penalty * np.square(coef).sum()), slope

    return fun


def _spark_fit(coded: DataFrame, k: int, penalty: float, l1_share: float, tol: float, max_iter: int, free: bool):
    family = "binomial" if k == 2 else "multinomial"
    estimator = _SparkLogistic(featuresCol="vector", labelCol="code", weightCol="weight", regParam=penalty, elasticNetParam=l1_share, standardization=False, family=family, tol=tol, maxIter=max_iter, fitIntercept=free)
    return estimator.fit(coded.withColumn("vector", array_to_vector("features")).select("vector", "code", "weight"))


def _partials(coded: DataFrame, compute, width: int) -> np.ndarray:
    """The sum over all rows of what ``compute`` (x, y, w) returns for a batch; long ones are merged in slices before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                y = batch.column(1).to_numpy(zero_copy_only=False)
                total += compute(np.asarray(batch.column(0).flatten(), float).reshape(len(y), -1), y, batch.column(2).to_numpy(zero_copy_only=False))
        slices = [total[i : i + SLICE] for i in range(0, width, SLICE)]
        yield partials.batch(np.arange(len(slices)), np.ones(len(slices)), slices)

    found = np.zeros(width)
    for r in partials.gathered(coded.select("features", "code", "weight").mapInArrow(run, partials.KIND), width * 8):
        part = np.frombuffer(r["sums"])
        found[r["cid"] * SLICE : r["cid"] * SLICE + len(part)] += part
    return found


def _evaluate(coded: DataFrame, coef: np.ndarray, intercept: np.ndarray, total: float, penalty: float, free: bool) -> tuple[float, np.ndarray, float]:
    """Objective, gradient (weights row by row, then intercepts), and its largest component."""
    k, d = coef.shape

    def compute(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = x @ coef.T + intercept
        r = _residuals(z, y) * w[:, None]
        return np.concatenate([[np.sum(w * _losses(z, y))], (r.T @ x).ravel(), r.sum(0)])

    sums = _partials(coded, compute, 1 + k * d + k) / total
    slope = sums[1:]
    slope[: k * d] += penalty * coef.ravel()
    if not free:
        slope = slope[: k * d]
    return float(sums[0] + 0.5 * penalty * np.square(coef).sum()), slope, float(np.abs(slope).max())


def _curvature(coded: DataFrame, coef: np.ndarray, intercept: float, total: float, penalty: float, free: bool) -> np.ndarray:
    d = len(coef) + free

    def compute(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        p = 0.5 * (1 + np.tanh(0.5 * (x @ coef + intercept)))
        x = np.column_stack([x, np.ones(len(x))]) if free else x
        return ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()

    h = _partials(coded, compute, d * d).reshape(d, d) / total
    h[np.arange(len(coef)), np.arange(len(coef))] += penalty
    return h


def _conjugate(coded: DataFrame, coef: np.ndarray, intercept: np.ndarray, slope: np.ndarray, total: float, penalty: float, free: bool) -> np.ndarray:
    """A Newton step by conjugate gradients, for any number of classes and features: each iteration is a pass that multiplies by the second derivatives."""
    k, d = coef.shape

    def times(v: np.ndarray) -> np.ndarray:
        way, shift = v[: k * d].reshape(k, d), v[k * d :] if free else 0.0

        def compute(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            z, moved = x @ coef.T + intercept, x @ way.T + shift
            if k == 1:
                p = 0.5 * (1 + np.tanh(0.5 * z))
                r = p * (1 - p) * moved
            else:
                p = _softmax(z)
                r = p * (moved - (p * moved).sum(1, keepdims=True))
            r = r * w[:, None]
            return np.concatenate([(r.T @ x).ravel(), r.sum(0)])

        found = _partials(coded, compute, k * d + k) / total
        found[: k * d] += penalty * v[: k * d]
        return found if free else found[: k * d]

    step, rest = np.zeros_like(slope), slope.copy()
    way, size = rest.copy(), rest @ rest
    enough = size * min(0.25, np.sqrt(np.sqrt(size))) ** 2
    for _ in range(CONJUGATE):
        bent = times(way)
        curve = way @ bent
        if curve <= 1e-300:
            break
        step += size / curve * way
        rest -= size / curve * bent
        before, size = size, rest @ rest
        if size <= enough:
            break
        way = rest + size / before * way
    return step


def reference_objective(df: DataFrame, coef: np.ndarray, intercept: np.ndarray, C: float, label: str = "code", weight: str | None = None) -> float:
    """The objective at given coefficients; ``label`` holds codes from 0."""
    rows = df.select("features", F.col(label).cast("int").alias("code"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))
    total = rows.agg(F.sum("weight")).first()[0]
    coef, intercept = np.atleast_2d(np.asarray(coef, float)), np.atleast_1d(np.asarray(intercept, float))
    return _evaluate(rows, coef, intercept, total, 0.0 if math.isinf(C) else 1 / (C * total), True)[0]


