"""Full-batch k-means (Lloyd) with k-means++ or random starts.

Each iteration is one pass: centers are broadcast, partial sums come back. A table of
checked small size is fetched once and passes are made in memory. A fit ends
when no label changes, else when the centers' squared shift is at most ``tol`` times
the mean variance of the features, else after ``max_iter`` passes. Empty clusters take
the farthest rows. Labels and inertia are from a fresh assignment to the final centers.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from typing import Self

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.errors import ConvergenceWarning, UnsupportedParameter
from halyard.functions.vectors import dense, lists, vector
from halyard.operators.base import Estimator
from halyard.plans.lloyd import dense_assign, inertia_of, total
from halyard.plans.nearest import closest, fits, mapped
from halyard.seeds import derive_seed, resolve_seed, uniform
from halyard.validation import Shape, checked, prepared, require_int, require_params


@dataclass
class Prepared:
    """A checked table with its starting centers; it serves any number of fits of the same settings."""

    rows: DataFrame
    shape: Shape
    starts: list[np.ndarray]
    tolerance: float
    settings: str


def first_centers(rows: DataFrame, k: int, dimensions: int, seed: int, init: str) -> np.ndarray:
    """Starting centers: rows chosen at random, or greedily by their share of the potential."""
    if init == "random":
        chosen = rows.orderBy(uniform(F.col("id"), seed, "random"), "id").limit(k).collect()
        return np.array([r["features"] for r in chosen], float)
    return plus_plus(rows, k, dimensions, seed)


#: Rounds and rows for each center that draw candidates from a table beyond memory.
ROUNDS, DRAWN = 5, 2


def plus_plus(rows: DataFrame, k: int, dimensions: int, seed: int) -> np.ndarray:
    """Greedy k-means++: of 2 + log(k) rows drawn in proportion to their squared distance, the one that lowers the potential most.

    Squared distances to the nearest center so far are kept, so a step costs the
    distances to the drawn rows alone. A table of checked small size is seeded in
    memory. Of a larger one, a few rounds each draw some ``DRAWN * k`` candidates in
    proportion to their distance from those before (Bahmani et al., 2012); candidates
    count as often as rows are nearest to them, and are seeded in the same way. Draws
    depend on ids, not on partitions.
    """
    held = Held.of(rows, dimensions, derive_seed(seed, "plus") >> 1)
    weight = None
    if held is None:
        held, weight = _candidates(rows, k, dimensions, seed)
    return greedy(held.x, held.key, np.ones(len(held.x)) if weight is None else weight, k, seed)


def greedy(x: np.ndarray, key: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Greedy k-means++ over weighted rows in memory; ``key`` holds a random number for each of them."""
    trials, norms = 2 + int(math.log(k)), np.einsum("ij,ij->i", x, x)
    least, chosen = None, []
    for step in range(k):
        mass = weight if least is None else weight * least
        drawn = _drawn(key, mass, derive_seed(seed, "step", step), 1 if step == 0 else trials)
        if not len(drawn):  # every row lies on a center
            return np.concatenate([x[chosen], np.repeat(x[chosen[:1]], k - step, axis=0)])
        now = _distances(x, norms, drawn)
        now = now if least is None else np.minimum(least[:, None], now)
        best = int(np.argmin(weight @ now)) if len(drawn) > 1 else 0
        least = now[:, best].copy()
        chosen.append(int(drawn[best]))
    return x[chosen]


def _drawn(key: np.ndarray, mass: np.ndarray, seed: int, tries: int) -> np.ndarray:
    """For each trial the first row to arrive in a race in which each one's rate is its mass."""
    able = np.flatnonzero(mass > 0)
    if not len(able):
        return able
    found = []
    for t in range(tries):
        mixed = (key[able] ^ np.uint64((seed + 0x9E3779B97F4A7C15 * (t + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        u = (((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)).astype(float) + 0.5) / 2**53
        found.append(able[np.argmin(-np.log(u) / mass[able])])
    return np.array(found)


def _distances(x: np.ndarray, norms: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to some; those that rounding might blur are computed directly."""
    both = norms[:, None] + norms[places][None, :]
    found = both - 2 * (x @ x[places].T)
    i, j = np.nonzero(found <= 1e-8 * both)
    for lo in range(0, len(i), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        gap = x[i[part]] - x[places[j[part]]]
        found[i[part], j[part]] = np.einsum("ij,ij->i", gap, gap)
    return found


@dataclass
class Held:
    """Rows in memory, in the order of id, and a hash of each id."""

    x: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, dimensions: int, seed: int = 0) -> Held | None:
        """The table, if it is small enough."""
        if not fits(rows.count(), dimensions + 1):
            return None
        return cls.read(rows, dimensions, seed)

    @classmethod
    def read(cls, rows: DataFrame, dimensions: int, seed: int) -> Held:
        table = rows.select("id", "features", F.xxhash64("id", F.lit(seed)).alias("key")).toArrow().sort_by("id").combine_chunks()
        return cls(dense(table.column("features"), dimensions), table.column("key").to_numpy().view(np.uint64))


def _candidates(rows: DataFrame, k: int, dimensions: int, seed: int) -> tuple[Held, np.ndarray]:
    """Rows that centers are chosen from, and for how many rows each stands. About ROUNDS * DRAWN * k of them reach the driver."""
    name = derive_seed(seed, "plus") >> 1
    first = rows.orderBy(uniform(F.col("id"), seed, "first"), "id").limit(1)
    held, rounds = Held.read(first, dimensions, name), 0
    while rounds < ROUNDS or len(held.x) < k:
        known = held.x
        far = mapped(rows.select("id", "features"), dimensions, {"least": "double"}, lambda x, known=known: [pa.array(closest(x, known)[1])])
        potential = far.agg(F.sum("least")).first()[0]
        if not potential:
            break
        rounds += 1
        more = Held.read(far.where(uniform(F.col("id"), seed, "round", rounds) < DRAWN * k / potential * F.col("least")), dimensions, name)
        held = Held(np.concatenate([known, more.x]), np.concatenate([held.key, more.key]))
    known = held.x
    label = mapped(rows.select("features"), dimensions, {"label": "int"}, lambda x: [pa.array(closest(x, known)[0].astype(np.int32))])
    weight = np.zeros(len(known))
    for r in label.groupBy("label").count().collect():  # a row a candidate
        weight[r["label"]] = r["count"]
    return held, weight


def relocated(rows: DataFrame, centers: np.ndarray, sums: np.ndarray, counts: np.ndarray, dimensions: int) -> tuple[np.ndarray, int]:
    """New means; empty clusters take the farthest rows (ties by id), whose clusters give them up."""
    empty = np.flatnonzero(counts == 0)
    sums, counts = sums.copy(), counts.copy()
    if len(empty):
        far = mapped(rows.select("id", "features"), dimensions, {"label": "int", "d2": "double"}, lambda x: [pa.array(a) for a in (lambda r: (r[0].astype(np.int32), r[1]))(closest(x, centers))])
        for slot, r in zip(empty, far.where(F.col("d2") > 0).orderBy(F.desc("d2"), "id").limit(len(empty)).collect(), strict=False):
            x = np.array(r["features"], float)
            sums[r["label"]] -= x
            counts[r["label"]] -= 1
            sums[slot] += x
            counts[slot] += 1
    means = sums / np.maximum(counts, 1)[:, None]
    return np.where((counts > 0)[:, None], means, means[int(counts.argmax())]), len(empty)


class Centers(Estimator):
    """What fitted centers offer, whatever fitted them."""

    def _readout(self, x: np.ndarray) -> np.ndarray:
        return x

    def _x(self, df: DataFrame) -> DataFrame:
        self._need("cluster_centers_")
        return df.withColumn("features", vector(df, self._features))

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, the nearest center."""
        rows, centers, own = self._x(df), self.cluster_centers_, self._readout
        return mapped(rows, self.n_features_in_, {"prediction": "int"}, lambda x: [pa.array(closest(own(x), centers)[0].astype(np.int32))])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``distances`` to all centers."""
        rows, centers, own = self._x(df), self.cluster_centers_, self._readout

        def compute(x: np.ndarray) -> list[pa.Array]:
            x = own(x)
            return [lists(np.sqrt(np.stack([np.square(x - c).sum(1) for c in centers], 1)))]

        return mapped(rows, self.n_features_in_, {"distances": "array<double>"}, compute)

    def score(self, df: DataFrame) -> float:
        """Minus the sum of squared distances to the nearest centers."""
        centers, own = self.cluster_centers_, self._readout
        return -total(self._x(df).select("features"), lambda x: closest(own(x), centers), len(centers), self.n_features_in_).inertia

    def fit_predict(self, df: DataFrame, **columns) -> DataFrame:
        return self.fit(df, **columns).predict(df)

    def fit_transform(self, df: DataFrame, **columns) -> DataFrame:
        return self.fit(df, **columns).transform(df)


def given(init, dimensions: int, k: int) -> np.ndarray:
    """Explicit centers from an array or a table of vectors."""
    if isinstance(init, DataFrame):
        init = [r[0] for r in init.collect()]
    centers = np.array(init, float)
    if centers.shape != (k, dimensions) or not np.isfinite(centers).all():
        raise ValueError(f"init must be finite and of shape {(k, dimensions)}; got {centers.shape}")
    return centers


class KMeans(Centers):
    """Lloyd's algorithm."""

    def __init__(
        self, n_clusters: int = 8, init="k-means++", n_init: int | str = "auto", max_iter: int = 300, tol: float = 1e-4, verbose: bool = False, random_state: int | None = None, copy_x: bool = True,
        algorithm: str = "lloyd", assignment_batch_size: int | None = None, statistics_batch_size: int = 65536,
    ) -> None:
        self.n_clusters, self.init, self.n_init, self.max_iter, self.tol, self.verbose = n_clusters, init, n_init, max_iter, tol, verbose
        self.random_state, self.copy_x, self.algorithm = random_state, copy_x, algorithm
        self.assignment_batch_size, self.statistics_batch_size = assignment_batch_size, statistics_batch_size

    def prepare(self, df: DataFrame, features: str | list[str] = "features", id_col: str = "id") -> Prepared:
        """Checks a table and draws the starting centers."""
        require_params("KMeans", algorithm=(self.algorithm, ("lloyd",)))
        k = require_int("n_clusters", self.n_clusters, 1)
        require_int("max_iter", self.max_iter, 1)
        if callable(self.init):
            raise UnsupportedParameter("KMeans: a callable init is not supported")
        if isinstance(self.tol, bool) or not math.isfinite(self.tol) or self.tol < 0:
            raise ValueError("tol must be a finite number of at least 0")
        rows = prepared(df, id_col, features).persist()
        shape = checked(rows)
        if k > shape.rows:
            raise ValueError(f"n_samples={shape.rows} should be >= n_clusters={k}")
        self._features, self._id_col = features, id_col
        seed, explicit = resolve_seed(self.random_state), not isinstance(self.init, str)
        if explicit:
            if self.n_init not in ("auto", 1):
                warnings.warn("explicit initial centers: one run is made", RuntimeWarning, stacklevel=3)
            starts = [given(self.init, shape.dimensions, k)]
        else:
            require_params("KMeans", init=(self.init, ("k-means++", "random")))
            runs = (10 if self.init == "random" else 1) if self.n_init == "auto" else require_int("n_init", self.n_init, 1)
            starts = [first_centers(rows, k, shape.dimensions, derive_seed(seed, "run", r) >> 1, self.init) for r in range(runs)]
        variances = rows.agg(*[F.var_pop(F.col("features")[i]).alias(f"v{i}") for i in range(shape.dimensions)]).first()
        return Prepared(rows, shape, starts, self.tol * float(np.mean(list(variances))), repr(self.get_params()))

    def train(self, ready: Prepared) -> Self:
        """Fits from prepared input; every call starts anew."""
        if ready.settings != repr(self.get_params()):
            raise ValueError("the prepared input does not match these settings")
        best, inertias = None, []
        for run, start in enumerate(ready.starts):
            found = self._run(ready, start)
            inertias.append(found[0])
            if best is None or found[0] < best[0]:
                best = (*found, run)
        self.inertia_, self.cluster_centers_, self.n_iter_, self.convergence_reason_, self.iteration_stats_, used, self.best_restart_ = best
        self.n_features_in_, self.n_init_, self.restart_inertias_ = ready.shape.dimensions, len(ready.starts), inertias
        self._ran("fit", "arrow", self.convergence_reason_, (ready.shape.rows, ready.shape.dimensions))
        if used < self.n_clusters:
            warnings.warn(f"Number of distinct clusters ({used}) found smaller than n_clusters ({self.n_clusters}). Possibly due to duplicate points in X.", ConvergenceWarning, stacklevel=3)
        return self

    def _run(self, ready: Prepared, centers: np.ndarray) -> tuple:
        rows, d, k = ready.rows, ready.shape.dimensions, self.n_clusters
        held = Held.of(rows, d)
        data = rows if held is None else held.x
        labels, stats, reason = None, [], "max_iter"
        for iteration in range(self.max_iter):
            found = total(data, dense_assign(centers), k, d)
            new, empty = relocated(rows, centers, found.sums, found.counts, d)
            shift = float(np.square(new - centers).sum())
            stats.append({"iteration": iteration + 1, "inertia_before_update": found.inertia, "center_shift_squared": shift, "empty_clusters": empty})
            unchanged = labels == found.labels
            labels, centers = found.labels, new
            if unchanged or shift <= ready.tolerance:
                reason = "labels" if unchanged else "tolerance"
                break
        final = total(data, dense_assign(centers), k, d)
        return final.inertia, centers, iteration + 1, reason, stats, int((final.counts > 0).sum())

    def fit(self, df: DataFrame, features: str | list[str] = "features", id_col: str = "id", weight: str | None = None) -> Self:
        if weight is not None:
            raise UnsupportedParameter("KMeans: sample weights are not supported")
        ready = self.prepare(df, features, id_col)
        try:
            return self.train(ready)
        finally:
            ready.rows.unpersist()


__all__ = ["Centers", "KMeans", "Prepared", "first_centers", "given", "inertia_of", "plus_plus", "relocated"]
