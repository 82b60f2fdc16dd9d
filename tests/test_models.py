import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.config import config_context, tuning_context
from halyard.diagnostics import get_last_backend_event
from halyard.errors import ConvergenceWarning, UnsupportedInput, UnsupportedParameter
from halyard.operators import decomposition, linear, svm
from halyard.operators.decomposition import PCA, choose_svd_solver, mle_dimension
from halyard.operators.linear import LogisticRegression, minimize
from halyard.operators.svm import SVC, kernel_diagonal, kernel_matrix, kkt_violations, ovo_votes, ovr_decision, solve
from halyard.plans import partials
from tests.test_neighbors import frame


def data(n=300, d=4, classes=2, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(classes, d)) * 1.2
    y = rng.integers(0, classes, n)
    return centers[y] + rng.normal(size=(n, d)) + shift, y.tolist()


# --- logistic regression


@pytest.mark.parametrize("path", ["memory", "spark_ml"])
@pytest.mark.parametrize(("classes", "C", "shift"), [(2, 1.0, 0.0), (3, 0.1, 0.0), (2, math.inf, 3.0), (4, 10.0, 0.0)])
def test_gradient_vanishes(spark, path, classes, C, shift):
    x, y = data(classes=classes, shift=shift)
    rows = frame(spark, x, y)
    with tuning_context(broadcast_bytes=1 if path == "spark_ml" else 1 << 26):
        model = LogisticRegression(C=C, max_iter=500, tol=1e-5).fit(rows)
    assert model.execution_backend_.split("+")[0] == path
    z = x @ model.coef_.T + model.intercept_
    if classes == 2:
        r = 1 / (1 + np.exp(-z)) - np.array(y)[:, None]
    else:
        e = np.exp(z - z.max(1, keepdims=True))
        r = e / e.sum(1, keepdims=True) - np.eye(classes)[y]
    slope = (r.T @ x + (0 if math.isinf(C) else model.coef_ / C)) / len(y)
    assert np.abs(slope).max() < 1e-5 and np.abs(r.sum(0)).max() / len(y) < 1e-5
    assert model.gradient_max_ < 1e-5
    got = model.predict_proba(model.predict(model.decision_function(rows))).orderBy("id").toPandas()
    want = (z[:, 0] > 0).astype(int) if classes == 2 else z.argmax(1)
    assert got["prediction"].tolist() == want.tolist()
    assert np.stack(got["probability"]).sum(1) == pytest.approx(1)
    assert model.score(rows) == pytest.approx((want == np.array(y)).mean())


@pytest.mark.parametrize(("classes", "free"), [(3, True), (2, False), (4, False)])
def test_conjugate_steps_reach_the_optimum(spark, monkeypatch, classes, free):
    """From a coarse fit, for shapes whose second derivatives are never formed."""
    x, y = data(classes=classes)
    rows, coarse = frame(spark, x, y), linear.minimize
    monkeypatch.setattr(linear, "NEWTON", 0)
    monkeypatch.setattr(linear, "minimize", lambda fun, p, tol, most: coarse(fun, p, 1e-2, most))
    model = LogisticRegression(C=0.5, tol=1e-9, fit_intercept=free).fit(rows)
    monkeypatch.undo()
    want = LogisticRegression(C=0.5, tol=1e-9, fit_intercept=free, max_iter=2000).fit(rows)
    assert model.execution_backend_ == "memory+newton" and model.gradient_max_ < 1e-9
    assert model.coef_ == pytest.approx(want.coef_, abs=1e-6) and model.objective_ == pytest.approx(want.objective_, abs=1e-12)


def test_weights_are_repetitions_and_classes(spark):
    x, y = data(120)
    w = [1 + i % 3 for i in range(120)]
    weighted = frame(spark, x, y).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    repeated = frame(spark, np.repeat(x, w, axis=0), np.repeat(y, w).tolist())
    one, two = LogisticRegression(tol=1e-8).fit(weighted, weight="w"), LogisticRegression(tol=1e-8).fit(repeated)
    assert one.coef_ == pytest.approx(two.coef_, abs=1e-6) and one.intercept_ == pytest.approx(two.intercept_, abs=1e-6)
    doubled = LogisticRegression(tol=1e-8, class_weight={1: 2.0}).fit(frame(spark, x, y))
    by_rows = LogisticRegression(tol=1e-8).fit(frame(spark, x, y).withColumn("w", 1.0 + F.col("label")), weight="w")
    assert doubled.coef_ == pytest.approx(by_rows.coef_, abs=1e-7)


def test_certificates_and_warnings(spark):
    x, y = data(200)
    rows = frame(spark, x, y)
    model = LogisticRegression(tol=1e-8, fit_intercept=False).fit(rows)
    assert -1e-9 < model.duality_gap(rows) < 1e-9
    assert model.objective(rows) == pytest.approx(model.objective_)
    with pytest.warns(ConvergenceWarning):
        LogisticRegression(max_iter=1, tol=1e-12).fit(frame(spark, *data(100, classes=3)))
    separable = frame(spark, [[-2.0], [-1.0], [1.0], [2.0]], [0, 0, 1, 1])
    assert LogisticRegression(C=1e6, max_iter=1000).fit(separable).score(separable) == 1


def test_logistic_refusals(spark):
    rows = frame(spark, [[0.0], [1.0]], [0, 1])
    for bad in ({"penalty": "l1"}, {"solver": "saga"}, {"dual": True}, {"warm_start": True}, {"intercept_scaling": 2}, {"l1_ratio": 0.5}):
        with pytest.raises(UnsupportedParameter):
            LogisticRegression(**bad).fit(rows)
    with pytest.raises(ValueError, match="one class"):
        LogisticRegression().fit(frame(spark, [[0.0], [1.0]], [1, 1]))
    with pytest.raises(ValueError, match="weight"):
        LogisticRegression().fit(rows.withColumn("w", F.lit(-1.0)), weight="w")


def test_fallback_serves_other_penalties(spark):
    x, y = data(200)
    rows = frame(spark, x, y)
    with config_context(fallback_policy="allow"):
        model = LogisticRegression(penalty="l1", C=0.01).fit(rows)
        assert get_last_backend_event().fallback and (model.coef_ == 0).any()
    assert model.centered_intercept_ == pytest.approx(model.intercept_ + model.coef_ @ x.mean(0))


def test_minimize_finds_the_valley():
    def rosenbrock(p):
        a, b = p
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert minimize(rosenbrock, np.array([-1.2, 1.0]), 1e-8, 500)[0] == pytest.approx([1, 1], abs=1e-6)


# --- support vector machines

KERNELS = [{"kernel": "linear"}, {"kernel": "rbf"}, {"kernel": "poly", "degree": 2, "coef0": 1.0}, {"kernel": "sigmoid", "gamma": 0.05}]


@pytest.mark.parametrize("kernel", KERNELS)
@pytest.mark.parametrize("classes", [2, 3])
def test_optimality(spark, kernel, classes):
    rows = frame(spark, *data(160, 3, classes))
    model = SVC(tol=1e-4, **kernel).fit(rows)
    assert model.converged_ and sum(r["violations"] for r in kkt_violations(model, rows, slack=1e-6).collect()) == 0
    balance = model.pair_coef_.sum(1)
    assert balance == pytest.approx(np.zeros(len(balance)), abs=1e-8)
    again = model.predict(rows.repartition(5)).orderBy("id").toPandas()["prediction"]
    assert (model.predict(rows).orderBy("id").toPandas()["prediction"] == again).all()


def test_dual_of_two_points():
    alpha, rho, _, ok = solve(np.array([[0.0], [2.0]]), np.array([1.0, -1.0]), np.array([10.0, 10.0]), 1e-8, 1000, kernel="linear")
    assert ok and alpha == pytest.approx([0.5, 0.5]) and rho == pytest.approx(-1)


def test_dual_value_beats_random_feasible_points(monkeypatch):
    x, y = data(40, 2)
    y = np.where(np.array(y) == 0, 1.0, -1.0)
    q = kernel_matrix(x, x, "rbf", 0.5) * np.outer(y, y)
    value = lambda a: 0.5 * a @ q @ a - a.sum()
    alpha, *_ = solve(x, y, np.full(40, 1.0), 1e-6, 10**6, kernel="rbf", gamma=0.5)
    monkeypatch.setattr(svm, "GRAM", 100)
    for cache_mb in (0.001, 0.008, 200):  # blocks of 16 and 26 rows, and of all
        blocks, _, _, ok = solve(x, y, np.full(40, 1.0), 1e-6, 10**6, cache_mb=cache_mb, kernel="rbf", gamma=0.5)
        assert ok and abs(y @ blocks) < 1e-9 and value(blocks) == pytest.approx(value(alpha))
    assert abs(y @ alpha) < 1e-9
    rng = np.random.default_rng(0)
    for _ in range(300):
        other = np.clip(alpha + rng.normal(size=40) * 0.05, 0, 1)
        more, less = other[y > 0].sum(), other[y < 0].sum()
        other[y > 0] *= min(1, less / more)
        other[y < 0] *= min(1, more / less)
        assert value(other) >= value(alpha) - 1e-6


@pytest.mark.parametrize("kernel", KERNELS[:3])
def test_pairs_beyond_one_task(spark, monkeypatch, kernel):
    rows = frame(spark, *data(160, 3, 3)).withColumn("w", 1 + F.col("id") % 3)
    want = SVC(tol=1e-5, **kernel).fit(rows, weight="w")
    monkeypatch.setattr(svm, "PAIR_ROWS", 105)
    monkeypatch.setattr(svm, "WORKING", 24)
    monkeypatch.setattr(svm, "HELD_BLOCKS", 2)
    found = SVC(tol=1e-5, **kernel).fit(rows, weight="w")
    assert found.converged_ and found.intercept_ == pytest.approx(want.intercept_, abs=1e-3)
    a, b = (np.stack(m.decision_function(rows).orderBy("id").toPandas()["decision"]) for m in (found, want))
    assert a == pytest.approx(b, abs=1e-3)
    assert sum(r["violations"] for r in kkt_violations(found, rows, weight="w", slack=1e-6).collect()) == 0


def test_votes():
    decision = np.array([[1.0, 1.0, 1.0], [0.0, 0.0, 0.0], [1.0, -1.0, 1.0], [-1.0, -2.0, 0.0]])
    assert ovo_votes(decision, 3).tolist() == [0, 2, 0, 2]
    values = ovr_decision(decision, 3)
    assert values[0] == pytest.approx([2 + 2 / 9, 1, -2 / 9])
    assert values[2].argmax() in (0, 1, 2) and np.all(np.abs(values - np.round(values)) < 1 / 3)


@pytest.mark.parametrize("kernel", KERNELS)
def test_diagonal(kernel):
    x = np.random.default_rng(0).normal(size=(7, 3))
    given = {"gamma": 0.3, "degree": 3, "coef0": 0.5} | kernel
    assert np.diag(kernel_matrix(x, x, **given)) == pytest.approx(kernel_diagonal(x, **given))


def test_svc_rules(spark):
    x, y = data(60)
    rows = frame(spark, x, y)
    for bad in ({"kernel": "precomputed"}, {"kernel": len}, {"probability": True}):
        with pytest.raises(UnsupportedParameter):
            SVC(**bad).fit(rows)
    with pytest.raises(ValueError, match="gamma"):
        SVC(gamma=0.0).fit(rows)
    with pytest.raises(ValueError, match="greater than one"):
        SVC().fit(frame(spark, x, [1] * 60))
    with pytest.raises(ValueError, match="positive weight"):
        SVC().fit(rows.withColumn("w", (F.col("label") == 0).cast("double")), weight="w")
    with pytest.warns(ConvergenceWarning):
        assert not SVC(max_iter=0).fit(rows).support_
    zero = SVC().fit(rows.withColumn("w", (F.col("id") % 2).cast("double")), weight="w")
    assert all(i % 2 for i in zero.support_)
    linear = SVC(kernel="linear").fit(rows)
    values = linear.decision_function(rows).orderBy("id").toPandas()["decision"].to_numpy()
    assert values == pytest.approx((x @ linear.coef_.T - linear.intercept_).ravel())
    assert linear.dual_coef_ @ linear.support_vectors_ == pytest.approx(linear.coef_)
    strings = SVC(class_weight="balanced").fit(rows.withColumn("label", F.when(F.col("label") == 0, "no").otherwise("yes")))
    assert strings.classes_ == ["no", "yes"]
    found = strings.predict(strings.decision_function(rows)).toPandas()
    assert ((found["decision"] > 0) == (found["prediction"] == "yes")).all()


# --- principal components


@pytest.mark.parametrize(("n", "d"), [(80, 6), (9, 14)])
def test_components_match_svd(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) * np.linspace(5, 1, d) + 1e3
    rows = frame(spark, x)
    k = 4
    model = PCA(k).fit(rows)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = v[:k] * np.sign(v[np.arange(k), np.abs(v[:k]).argmax(1)])[:, None]
    assert model.components_ == pytest.approx(v, abs=1e-6)
    assert model.explained_variance_ == pytest.approx(s[:k] ** 2 / (n - 1))
    assert model.noise_variance_ == pytest.approx((s[k : min(n, d)] ** 2).mean() / (n - 1), abs=1e-9)
    z = np.stack(model.transform(rows).orderBy("id").toPandas()["projection"])
    assert z == pytest.approx((x - x.mean(0)) @ v.T, abs=1e-6)
    back = np.stack(model.inverse_transform(model.transform(rows)).orderBy("id").toPandas()["reconstruction"])
    assert back == pytest.approx(z @ v + x.mean(0), abs=1e-6)
    white = PCA(2, whiten=True).fit_transform(rows).orderBy("id").toPandas()["projection"]
    assert np.cov(np.stack(white).T) == pytest.approx(np.eye(2), abs=1e-6)


def test_gram_merged_by_line_is_the_same(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(90, 5))
    one = PCA(3).fit(frame(spark, x))
    monkeypatch.setattr(partials, "DIRECT", 0)
    two = PCA(3).fit(frame(spark, x))
    assert one.components_ == pytest.approx(two.components_) and one.mean_ == pytest.approx(two.mean_)


def test_components_beyond_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 40)) * np.r_[9, 7, 5, 4, np.ones(36)] @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + 3
    rows = frame(spark, x)
    want = PCA(3, whiten=True).fit(rows)
    monkeypatch.setattr(decomposition, "SIDE", 20)
    found = PCA(3, whiten=True, svd_solver="randomized").fit(rows)
    for name in ("explained_variance_", "explained_variance_ratio_", "singular_values_", "noise_variance_", "mean_"):
        assert getattr(found, name) == pytest.approx(getattr(want, name), rel=1e-6)
    assert found.components_ == pytest.approx(want.components_, abs=1e-4) and found.execution_backend_ == "subspace"
    for bad in (None, 0.5):
        with pytest.raises((UnsupportedInput, ValueError)):
            PCA(bad).fit(rows)


def test_likelihood_is_that_of_the_covariance(spark):
    x = np.random.default_rng(0).normal(size=(100, 4)) * [3, 2, 1, 1]
    rows = frame(spark, x)
    model = PCA(2).fit(rows)
    c, r = model.get_covariance(), x - x.mean(0)
    want = -0.5 * (np.einsum("ij,jk,ik->i", r, model.get_precision(), r) + np.linalg.slogdet(c)[1] + 4 * math.log(2 * math.pi))
    assert model.score_samples(rows).orderBy("id").toPandas()["log_likelihood"].to_numpy() == pytest.approx(want)
    assert model.score(rows) == pytest.approx(want.mean())


def test_number_of_components(spark):
    x = np.random.default_rng(0).normal(size=(400, 5)) * [10, 8, 0.1, 0.1, 0.1]
    rows = frame(spark, x)
    assert PCA(0.95).fit(rows).n_components_ == 2
    assert PCA("mle").fit(rows).n_components_ == 2 == mle_dimension(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1], 400)
    assert PCA().fit(rows).n_components_ == 5
    for bad in (6, -1, 1.5, "all", True):
        with pytest.raises(ValueError, match="n_components"):
            PCA(bad).fit(rows)
    assert choose_svd_solver(10_000, 100, None, "auto") == "covariance_eigh"
    assert choose_svd_solver(400, 400, 10, "auto") == "full"
    assert choose_svd_solver(2000, 1500, 10, "auto") == "randomized"
    assert choose_svd_solver(2000, 1500, None, "auto") == "full"


def test_partitions_do_not_matter(spark):
    x, y = data(100, 3)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = [(LogisticRegression().fit(f).coef_, PCA(2).fit(f).components_, SVC().fit(f).intercept_) for f in (frame(spark, x, y, p) for p in (1, 7))]
    for a, b in zip(*found, strict=True):
        assert a == pytest.approx(b, abs=1e-9)




@pytest.mark.parametrize("tuning", [{}, {"block_bytes": 200, "broadcast_bytes": 1}])
def test_kernel_sums_hold_a_tile_at_a_time(spark, tuning, monkeypatch):
    x = np.random.default_rng(2).integers(-4, 5, (300, 1)) / 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    kernels = {"a": {"kernel": "rbf", "gamma": 0.5}, "b": {"kernel": "poly", "gamma": 0.1, "degree": 2, "coef0": 1.0}}
    with tuning_context(tile_values=20, **tuning):
        found = {r["id"]: (r["a"], r["b"]) for r in svm.kernel_sums(rows, 1, kernels).collect()}
    want = np.stack([kernel_matrix(x, x, **kernel).sum(1) for kernel in kernels.values()], 1)
    assert [found[i] for i in range(300)] == [pytest.approx(tuple(w)) for w in want]

    def small(a, b, **kernel):
        assert len(a) * len(b) <= 20
        return kernel_matrix(a, b, **kernel)

    monkeypatch.setattr(svm, "kernel_matrix", small)
    assert svm._tiled_sums(x, x, np.ones(300), kernels["a"], 20) == pytest.approx(want[:, 0])


def test_large_pairs_compute_few_kernel_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 3)), np.where(np.arange(300) % 2, 1.0, -1.0)
    whole = solve(x, y, np.ones(300), 1e-6, 10**6, kernel="rbf", gamma=0.5)
    most = []

    def counted(a, b, **kernel):
        most.append(len(a))
        return kernel_matrix(a, b, **kernel)

    monkeypatch.setattr(svm, "GRAM", 100)
    monkeypatch.setattr(svm, "kernel_matrix", counted)
    alpha, rho, _, converged = solve(x, y, np.ones(300), 1e-6, 10**6, cache_mb=0.1, kernel="rbf", gamma=0.5)
    assert converged and max(most) <= 32
    assert alpha == pytest.approx(whole[0], abs=1e-4) and rho == pytest.approx(whole[1], abs=1e-5)
