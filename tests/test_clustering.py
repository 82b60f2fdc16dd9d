import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.config import tuning_context
from halyard.errors import ConvergenceWarning, UnsupportedParameter
from halyard.operators import kmeans, schedules
from halyard.operators.emeans import EMeans, OMeans, build_cells, ema, normalized, rounded, split, split_plan
from halyard.operators.kmeans import KMeans, first_centers, plus_plus
from halyard.plans import partials
from halyard.plans.lloyd import stamped
from halyard.plans.nearest import closest
from halyard.streaming.clustering import StreamingCenters
from tests.test_neighbors import frame

BLOBS = np.concatenate([np.random.default_rng(410).normal(c, 0.35, (47, 3)) for c in (-3, 0, 4)])


def lloyd(x, centers, iterations):
    """Plain Lloyd without empty clusters."""
    for _ in range(iterations):
        label = np.square(x[:, None] - centers).sum(2).argmin(1)
        centers = np.array([x[label == c].mean(0) for c in range(len(centers))])
    return centers


# --- k-means


def test_iterations_match_plain_lloyd(spark):
    start = BLOBS[[0, 47, 94]] + 0.1
    for n in (1, 2, 5):
        model = KMeans(3, init=start, max_iter=n, tol=0).fit(frame(spark, BLOBS))
        assert model.cluster_centers_ == pytest.approx(lloyd(BLOBS, start, n))
        d2 = np.square(BLOBS[:, None] - model.cluster_centers_).sum(2).min(1)
        assert model.inertia_ == pytest.approx(d2.sum())


def test_labels_are_fresh(spark):
    """After one iteration labels belong to the new centers, not to those that made them."""
    rows = frame(spark, [[0.0], [2.0], [3.0], [8.0], [9.0], [10.0]])
    model = KMeans(2, init=[[0.0], [2.0]], max_iter=1, tol=0).fit(rows)
    assert model.cluster_centers_.ravel().tolist() == [0.0, 6.4]
    assert [r["prediction"] for r in model.predict(rows).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1]
    assert model.score(rows) == pytest.approx(-model.inertia_)


def test_candidates_beyond_memory(spark):
    rows = frame(spark, BLOBS)
    with tuning_context(broadcast_bytes=1):
        far = plus_plus(rows, 5, 3, 9)
        assert np.array_equal(plus_plus(rows.repartition(7), 5, 3, 9), far)
        every = plus_plus(frame(spark, np.repeat(np.arange(20.0), 3)[:, None]), 20, 1, 4)
        same = plus_plus(frame(spark, np.ones((9, 2))), 3, 2, 1)
        fit = KMeans(3, random_state=2).fit(rows)
    assert len(np.unique(far, axis=0)) == 5 and closest(BLOBS, far)[1].sum() < 2 * closest(BLOBS, plus_plus(rows, 5, 3, 9))[1].sum()
    assert sorted(every.ravel()) == list(range(20)) and same.shape == (3, 2) and (same == 1).all()
    assert KMeans(3, random_state=2).fit(rows).inertia_ == pytest.approx(fit.inertia_)


def test_greedy_draws_lower_the_potential_and_take_every_place():
    rng = np.random.default_rng(0)
    x, key = rng.normal(size=(2000, 8)) + rng.integers(0, 9, (2000, 1)) * 5, rng.integers(0, 2**63, 2000).astype(np.uint64)
    found = kmeans.greedy(x, key, np.ones(2000), 40, 3)
    plain = np.mean([closest(x, x[rng.choice(2000, 40, replace=False)])[1].sum() for _ in range(5)])
    assert closest(x, found)[1].sum() < plain
    places = np.repeat(rng.normal(size=(30, 8)) * 1e6 + 1e9, 4, axis=0)
    assert len(np.unique(kmeans.greedy(places, key[:120], np.ones(120), 30, 1), axis=0)) == 30


def test_weights_count_as_rows():
    x = np.array([[0.0], [1.0], [10.0], [11.0]])
    shares = np.mean([kmeans.greedy(x, np.arange(4, dtype=np.uint64), np.array([1.0, 1.0, 1.0, 97.0]), 1, s).ravel() for s in range(3000)] == np.array(11.0))
    assert shares == pytest.approx(0.97, abs=0.02)


def test_stamps_tell_labels_apart():
    x = np.random.default_rng(1).normal(size=(500, 3))
    label = np.arange(500) % 7
    one, order = stamped(x, label), np.random.default_rng(2).permutation(500)
    assert stamped(x[order], label[order]) == one and (stamped(x[:200], label[:200]) + stamped(x[200:], label[200:])) % 2**64 == one
    label[17] += 1
    assert stamped(x, label) != one


def test_sums_merged_by_cluster_are_the_same(spark, monkeypatch):
    start = BLOBS[[0, 47, 94]] + 0.1
    one = KMeans(3, init=start, max_iter=3, tol=0).fit(frame(spark, BLOBS, parts=5))
    monkeypatch.setattr(partials, "DIRECT", 0)
    with tuning_context(broadcast_bytes=1):
        two = KMeans(3, init=start, max_iter=3, tol=0).fit(frame(spark, BLOBS, parts=5))
    assert one.cluster_centers_ == pytest.approx(two.cluster_centers_) and one.inertia_ == pytest.approx(two.inertia_) and one.n_iter_ == two.n_iter_


def test_stopping(spark):
    rows = frame(spark, BLOBS)
    assert KMeans(3, random_state=1).fit(rows).convergence_reason_ in ("labels", "tolerance")
    assert KMeans(3, random_state=1, tol=0).fit(rows).convergence_reason_ in ("labels", "tolerance")
    assert KMeans(3, init=BLOBS[:3], max_iter=1, tol=0).fit(rows).convergence_reason_ == "max_iter"
    assert KMeans(3, tol=1e9).fit(rows).n_iter_ == 1


def test_empty_clusters_take_the_farthest_rows(spark):
    x = np.array([[0.0], [0.1], [0.2], [10.0], [20.0]])
    model = KMeans(3, init=[[0.0], [1000.0], [2000.0]], max_iter=1, tol=0).fit(frame(spark, x))
    assert sorted(model.cluster_centers_.ravel()) == pytest.approx([0.1, 10.0, 20.0])
    assert model.iteration_stats_[0]["empty_clusters"] == 2
    with pytest.warns(ConvergenceWarning, match="distinct"):
        same = KMeans(3, init=[[5.0], [6.0], [7.0]]).fit(frame(spark, np.ones((6, 1))))
    assert np.all(same.cluster_centers_ == 1)


def test_plus_plus_spreads_and_is_stable(spark):
    rows = frame(spark, BLOBS)
    found = plus_plus(rows, 3, 3, 5)
    assert sorted(closest(found, np.array([[-3.0] * 3, [0.0] * 3, [4.0] * 3]))[0]) == [0, 1, 2]
    assert np.array_equal(found, plus_plus(rows.repartition(9), 3, 3, 5))
    random = first_centers(rows, 5, 3, 1, "random")
    assert len(np.unique(random, axis=0)) == 5 and np.array_equal(random, first_centers(rows.repartition(2), 5, 3, 1, "random"))
    twice = plus_plus(frame(spark, np.ones((5, 2))), 3, 2, 1)
    assert twice.shape == (3, 2) and np.all(twice == 1)


def test_draws_follow_the_potential(spark):
    """The second center is drawn in proportion to squared distance (greedy choice aside)."""
    x = np.array([[0.0]] * 50 + [[1.0], [2.0], [3.0]])
    first = 0
    for seed in range(30):
        centers = kmeans.plus_plus(frame(spark, x, parts=1), 2, 1, seed).ravel()
        first += 3.0 in centers
    assert first > 15


def test_restarts_and_prepared_input(spark):
    rows = frame(spark, BLOBS)
    model = KMeans(3, init="random", n_init=3, random_state=3)
    ready = model.prepare(rows)
    one = model.train(ready).cluster_centers_.copy()
    assert np.array_equal(one, model.train(ready).cluster_centers_)
    assert model.inertia_ == min(model.restart_inertias_) and len(model.restart_inertias_) == 3
    with pytest.raises(ValueError, match="settings"):
        model.set_params(tol=0.5).train(ready)
    with pytest.warns(RuntimeWarning):
        KMeans(3, init=BLOBS[:3], n_init=4).fit(rows)
    for bad in (KMeans(3, algorithm="elkan"), KMeans(3, init=len), KMeans(3, init="spread")):
        with pytest.raises(UnsupportedParameter):
            bad.fit(rows)
    with pytest.raises(UnsupportedParameter):
        KMeans(2).fit(rows, weight="id")
    for bad in (KMeans(0), KMeans(500), KMeans(2, tol=-1), KMeans(2, init=[[1.0]])):
        with pytest.raises(ValueError, match="n_clusters|n_samples|tol|init"):
            bad.fit(rows)
    found = model.transform(model.predict(rows)).toPandas()
    assert (np.stack(found["distances"]).argmin(1) == found["prediction"]).all()


# --- schedules


def test_powers_and_passes():
    assert [schedules.nearest_power(v) for v in (0.3, 1, 1.4, 1.5, 2.82, 2.83, 3, 100)] == [1, 1, 1, 2, 2, 4, 4, 128]
    assert [schedules.lengths(10, e) for e in (0.5, 1, 2.5, 3)] == [[5], [10], [10, 5, 10], [10, 10, 10]]
    s = schedules.plan(100, 5, 2, 3, batch_size=10, alpha0=1.0)
    assert s.alpha(0) == 1 and s.alpha(30) == pytest.approx(0.1) and s.alpha(15) == pytest.approx(0.55)
    assert s.closing(1, 200) is None and s.closing(2, 210) == 1


def test_laws():
    s = schedules.plan(1_000_000, 16_384, 96, 3)
    assert s.batch_size == schedules.nearest_power(0.035 * 16_384**0.13 * 1e6**0.88 * 3**0.81)
    assert s.alpha0 == pytest.approx(min(1, 0.824 * 16_384**-0.46 * s.batch_size**0.9 * 1e6**-0.45 * 3**-0.11))
    assert schedules.plan(3_000_000, 100, 8, 1).batch_law == "quality"
    assert schedules.plan(1000, 10, 2, 1, recipe="faiss").unused_threshold == 0
    assert schedules.plan(1000, 10, 3, 1, batch_size=10**9).batch_size == 1000
    assert [schedules.cells_for(k) for k in (8, 1000, 2048, 2176, 16_384)] == [8, 16, 16, 32, 128]
    assert schedules.lists_for(16_385, 96, 128) == 24 and schedules.lists_for(1000, 512, 128) == 12
    t = schedules.plan_two_level(10_000, 64, 16, 1.5)
    assert t.recent and t.least_closing > 0 and not schedules.plan_two_level(10_000, 64, 16, 2).recent
    assert t.closing(0, 15_000) == 1 and t.closing(0, 5_000) == pytest.approx(math.exp(-1))
    half = schedules.plan_two_level(10_000, 64, 16, 0.5, batch_size=100)
    assert half.pass_rows == [5000] and half.closing(0, 5000) == 1 and half.refile_after(True) == 5 and half.refile_after(False) == 50
    for bad in ({"budget": 0}, {"alpha0": 2}, {"recipe": "x"}, {"batch_law": "x"}, {"unused_threshold": 1}, {"batch_size": 0}, {"budget": 1e-9}, {"k": 101}):
        with pytest.raises(ValueError, match="max_iter|alpha0|recipe|batch_law|unused|batch_size|fewer"):
            schedules.plan(**({"n": 100, "k": 5, "d": 2, "budget": 1} | bad))


def test_cells_that_spare_nothing_are_given_up(spark):
    rows = frame(spark, BLOBS)
    model = OMeans(30, max_iter=3, batch_size=20, n_cells=4, n_probe=1, init=np.repeat(BLOBS[:1], 30, 0), unused_threshold=0.0)
    found = model.fit(rows).recipe_  # all centers begin at one place, so one cell holds them all
    assert found["search"] == "dense" and found["search_fallback_step"] == 1
    forced = OMeans(30, max_iter=3, batch_size=20, n_cells=4, n_probe=1, init=np.repeat(BLOBS[:1], 30, 0), unused_threshold=0.0, assignment="two_level").fit(rows).recipe_
    assert forced["search"] == "two_level" and forced["search_fallback_step"] is None


@pytest.mark.parametrize("value", [1.0, -1.0, 0.0, -3.0, 3.3895e38])
def test_split_that_bfloat16_cannot_hold_is_mended(value):
    centers, mass = np.array([[value, value], [9.0, 9.0]]), np.array([4.0, 0.0])
    child, donor = (rounded(c, "bfloat16") for c in split(centers, mass, np.array([1]), np.array([0]), 1e-4, "bfloat16")[0][::-1])
    assert child[0] != donor[0] and child[1] == donor[1]
    assert np.isfinite(child).all() and (child[0] > donor[0]) == (value < 1e38)


# --- moving averages


def test_update_and_splits():
    centers, mass = ema(np.array([[0.0, 0.0], [5.0, 5.0]]), np.array([1.0, 1.0]), np.array([[4.0, 8.0], [0.0, 0.0]]), np.array([4.0, 0.0]), 0.25)
    assert centers.tolist() == [[4 * 0.25 / 1.75, 8 * 0.25 / 1.75], [5.0, 5.0]] and mass.tolist() == [1.75, 0.75]
    kept, _ = ema(np.array([[1.0]]), np.array([3.0]), np.zeros((1, 1)), np.zeros(1), 1.0)
    assert kept.tolist() == [[1.0]]
    children, donors = split_plan(np.array([10.0, 0.0, 30.0, 0.1, 0.0]), np.full(5, 0.5), 0.1)
    assert children.tolist() == [1, 3] and donors.tolist() == [2, 0]
    races = [split_plan(np.array([1.0, 3.0, 0.0]), u, 0.1)[1][0] for u in np.random.default_rng(0).random((4000, 3))]
    assert np.mean(races) == pytest.approx(0.75, abs=0.03)
    centers, mass = split(np.arange(10.0).reshape(5, 2), np.array([10.0, 0.0, 30.0, 0.1, 0.0]), children, donors, 0.5)
    assert centers[1].tolist() == [6.0, 2.5] and centers[2].tolist() == [2.0, 7.5] and mass.tolist() == [5.0, 15.0, 15.0, 5.0, 0.0]
    assert normalized(np.array([[3.0, 4.0], [0.0, 0.0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("kind", [EMeans, OMeans])
def test_memory_and_spark_give_one_result(spark, kind):
    rows = frame(spark, BLOBS)
    settings = {"n_clusters": 6, "max_iter": 2.5, "batch_size": 30, "random_state": 4}
    if kind is OMeans:
        settings |= {"n_cells": 3, "n_probe": 1, "assignment": "two_level"}
    one = kind(**settings).fit(rows)
    with tuning_context(broadcast_bytes=1):
        two = kind(**settings).fit(rows.repartition(5))
    assert one.cluster_centers_ == pytest.approx(two.cluster_centers_) and one.n_steps_ == two.n_steps_
    assert one.inertia_ == pytest.approx(two.inertia_)
    assert [s["rows"] for s in one.epoch_stats_][0] == 141


@pytest.mark.parametrize("kind", [EMeans, OMeans])
def test_assignments_of_the_last_pass(spark, kind):
    rows = frame(spark, BLOBS)
    model = kind(3, max_iter=2, batch_size=30, init=BLOBS[[0, 47, 94]], unused_threshold=0.0)
    plain = kind(3, max_iter=2, batch_size=30, init=BLOBS[[0, 47, 94]], unused_threshold=0.0).fit(rows)
    ready = model.prepare(rows)
    model.train(ready, capture_assignments=True)
    assert model.cluster_centers_ == pytest.approx(plain.cluster_centers_)
    found = model.captured_.orderBy("id").toPandas()
    assert found["id"].tolist() == list(range(141)) and found["label"].tolist() == np.repeat([0, 1, 2], 47).tolist()


def test_fit_is_good_on_blobs(spark):
    rows = frame(spark, BLOBS)
    best = KMeans(3, random_state=0).fit(rows).inertia_
    for model in (EMeans(3, max_iter=5, batch_size=20, init="k-means++"), OMeans(3, max_iter=5, batch_size=20, init="k-means++"), EMeans(3, max_iter=5, batch_size=20, init="k-means++", finalization="ema"), EMeans(3, max_iter=5, batch_size=20, init="k-means++", finalization="slow_ema", slow_ema_half_life=3)):
        assert model.fit(rows).inertia_ < 1.3 * best


def test_spherical_centers_have_length_one(spark):
    rows = frame(spark, BLOBS)
    model = EMeans(3, spherical=True, batch_size=40).fit(rows)
    assert np.linalg.norm(model.cluster_centers_, axis=1) == pytest.approx(1)
    assert model.transform(rows).count() == 141
    for bad in ({"precision": "int8"}, {"finalization": "x"}, {"assignment": "two_level"}):
        with pytest.raises(UnsupportedParameter):
            EMeans(3, **bad).fit(rows)


def test_low_precision_rounds_operands(spark):
    x = np.array([1.0, 1.00390625, 1.01171875, -3.14159, 0.0, 65280.0])
    assert rounded(x, "bfloat16").tolist() == [1.0, 1.0, 1.015625, -3.140625, 0.0, 65280.0]
    assert rounded(x, "float16")[3] == np.float16(-3.14159) and rounded(x, "float32") is x
    rows = frame(spark, BLOBS)
    full = EMeans(3, batch_size=30, init=BLOBS[[0, 47, 94]]).fit(rows)
    for precision in ("float16", "bfloat16"):
        low = EMeans(3, batch_size=30, init=BLOBS[[0, 47, 94]], precision=precision).fit(rows)
        assert low.cluster_centers_ == pytest.approx(full.cluster_centers_, abs=0.05)


def test_all_cells_are_a_full_search():
    rng = np.random.default_rng(0)
    centers, x = rng.normal(size=(40, 4)), rng.normal(size=(300, 4))
    cells = build_cells(centers, 6, 4, None, rng)
    label, d2 = cells.assign(centers, 6, [0.0])(x)
    full, want = closest(x, centers)
    assert np.array_equal(label, full) and d2 == pytest.approx(want)
    spent = [0.0]
    near, _ = cells.assign(centers, 2, spent)(x)
    assert (near == full).mean() > 0.6 and spent[0] < 300 * 40
    cells.child[full[0]] = (full[0] + 1) % 40
    assert cells.assign(centers, 6, [0.0])(x)[0][0] == full[0]


def test_streamed_updates(spark, tmp_path):
    rows = frame(spark, BLOBS)
    rows.select("features").write.parquet(str(tmp_path / "in"))
    centers = StreamingCenters(BLOBS[[0, 47, 94]], alpha=1.0)
    stream = spark.readStream.schema("features array<double>").parquet(str(tmp_path / "in"))
    centers.follow(stream, str(tmp_path / "check"), str(tmp_path / "state")).awaitTermination(60)
    assert centers.centers == pytest.approx(lloyd(BLOBS, BLOBS[[0, 47, 94]], 1))
    assert spark.read.parquet(str(tmp_path / "state")).agg(F.sum("mass")).first()[0] == 141
    before = centers.centers.copy()
    centers.update(rows, 0)
    assert np.array_equal(before, centers.centers)
