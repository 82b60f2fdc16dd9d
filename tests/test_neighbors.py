import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from halyard.config import tuning_context
from halyard.errors import SparseInput, UnsupportedInput, UnsupportedParameter
from halyard.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors
from halyard.plans import nearest
from halyard.plans.blocks import blocks

PLANS = {"broadcast_train": {}, "broadcast_query_blocks": {"broadcast_bytes": 1, "block_bytes": 4000, "tile_values": 500}}


def frame(spark, x, labels=None, parts=3):
    rows = [(i, v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(np.asarray(x, float))]
    kind = {str: "string", float: "double"}.get(type(None if labels is None else labels[0]), "long")
    return spark.createDataFrame(rows, f"id long, features array<double>, label {kind}").repartition(parts)


def brute(q, x, k=None, radius=None, own=False):
    d2 = np.square(q[:, None, :] - x[None, :, :]).sum(2)
    out = []
    for i, row in enumerate(d2):
        order = [j for j in np.lexsort((np.arange(len(x)), row)) if not (own and i == j)]
        order = order[:k] if k else [j for j in order if row[j] <= radius**2]
        out += [(i, r + 1, int(j), float(np.sqrt(row[j]))) for r, j in enumerate(order)]
    return out


@pytest.fixture(params=list(PLANS))
def plan(request):
    with tuning_context(**PLANS[request.param]):
        yield request.param


@pytest.mark.parametrize("kind", ["normal", "ties", "offset", "duplicates"])
@pytest.mark.parametrize("own", [True, False])
def test_exact_order_in_both_plans(spark, plan, kind, own):
    rng = np.random.default_rng(7)
    x = {"normal": rng.normal(size=(150, 5)), "ties": rng.integers(0, 3, (150, 3)), "offset": rng.normal(size=(150, 4)) + 1e4, "duplicates": np.repeat(rng.normal(size=(15, 4)), 10, axis=0)}[kind].astype(float)
    q = x if own else np.concatenate([rng.normal(size=(20, x.shape[1])), x[:5]])
    model = NearestNeighbors(4).fit(frame(spark, x))
    got = sorted(map(tuple, model.kneighbors(None if own else frame(spark, q)).collect()))
    want = brute(q, x, 4, own=own)
    assert model.last_query_backend_ == plan
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12, abs=1e-12)


def test_radius_in_both_plans(spark, plan):
    x = np.random.default_rng(1).integers(0, 5, (120, 2)).astype(float)
    got = sorted((r["qid"], r["id"]) for r in NearestNeighbors(radius=1.0).fit(frame(spark, x)).radius_neighbors().collect())
    assert got == sorted((q, i) for q, _, i, _ in brute(x, x, radius=1.0, own=True))
    graph = NearestNeighbors(radius=1.0).fit(frame(spark, x)).radius_neighbors_graph(frame(spark, x[:3]), mode="distance").collect()
    assert len(graph) == len(brute(x[:3], x, radius=1.0))


def test_votes_and_means(spark):
    x = np.array([[0.0], [0.0], [1.0], [1.0], [3.0]])
    labels = ["b", "a", "b", "a", "c"]
    model = KNeighborsClassifier(4).fit(frame(spark, x, labels))
    asked = frame(spark, [[0.0], [0.5], [3.0]])
    assert {r["qid"]: r["prediction"] for r in model.predict(asked).collect()} == {0: "a", 1: "a", 2: "b"}
    shares = {(r["qid"], r["label"]): r["probability"] for r in model.predict_proba(asked).collect()}
    assert shares[0, "c"] == 0 and shares[2, "c"] == 0.25 and sum(p for (q, _), p in shares.items() if q == 2) == 1
    near = KNeighborsClassifier(4, weights="distance").fit(frame(spark, x, labels))
    assert {r["qid"]: r["prediction"] for r in near.predict(asked).collect()}[2] == "c"
    targets = KNeighborsRegressor(2, weights="distance").fit(frame(spark, x, [1.0, 2.0, 3.0, 4.0, 5.0]))
    got = {r["qid"]: r["prediction"] for r in targets.predict(frame(spark, [[0.0], [2.0]])).collect()}
    assert got[0] == 1.5 and got[1] == pytest.approx(3.5)
    assert KNeighborsRegressor(1).fit(frame(spark, x, [1.0, 2.0, 3.0, 4.0, 5.0])).score(frame(spark, [[3.0], [1.0]], [5.0, 3.0])) == 1
    assert model.score(frame(spark, [[3.0], [0.0]], ["b", "b"])) == 0.5


def test_refusals(spark):
    x = frame(spark, [[0.0], [1.0]])
    for bad in ({"algorithm": "kd_tree"}, {"metric": "manhattan"}, {"p": 1}, {"metric_params": {"w": 1}}):
        with pytest.raises(UnsupportedParameter):
            NearestNeighbors(**bad).fit(x)
    with pytest.raises(UnsupportedParameter):
        KNeighborsClassifier(weights="none").fit(x)
    model = NearestNeighbors(2).fit(x)
    with pytest.raises(ValueError, match="Expected n_neighbors < n_samples_fit"):
        model.kneighbors()
    with pytest.raises(ValueError, match="n_neighbors"):
        model.kneighbors(x, 0)
    with pytest.raises(ValueError, match="features"):
        model.kneighbors(frame(spark, [[1.0, 2.0]]))
    assert model.kneighbors(x.where("id < 0")).count() == 0
    for bad in ([[float("nan")]], [[float("inf")]], []):
        with pytest.raises(ValueError, match="X"):
            NearestNeighbors(1).fit(spark.createDataFrame([(i, v) for i, v in enumerate(bad)], "id long, features array<double>"))
    with pytest.raises(SparseInput):
        NearestNeighbors(1).fit(spark.createDataFrame([(0, Vectors.sparse(2, [0], [1.0]))], ["id", "features"]))
    with pytest.raises(UnsupportedInput):
        KNeighborsClassifier(1).fit(spark.createDataFrame([(0, [1.0], [1])], "id long, features array<double>, label array<int>"))


def test_save_and_load(spark, tmp_path):
    x = frame(spark, np.random.default_rng(0).normal(size=(30, 2)), ["a", "b", "c"] * 10)
    model = KNeighborsClassifier(3).fit(x)
    model.save(spark, str(tmp_path / "m"))
    again = KNeighborsClassifier.load(spark, str(tmp_path / "m"))
    assert again.get_params() == model.get_params() and again.classes_ == model.classes_
    assert sorted(map(tuple, again.predict(x).collect())) == sorted(map(tuple, model.predict(x).collect()))


def test_other_forms_of_vectors(spark):
    dense = spark.createDataFrame([(i, Vectors.dense([float(i), 1.0])) for i in range(5)], ["id", "v"])
    columns = spark.createDataFrame([(f"k{i}", i, 1.0) for i in range(5)], "name string, a int, b double")
    assert NearestNeighbors(1).fit(dense, "v").kneighbors().count() == 5
    got = {r["qid"]: r["id"] for r in NearestNeighbors(1).fit(columns, ["a", "b"], "name").kneighbors().collect()}
    assert got == {"k0": "k1", "k1": "k0", "k2": "k1", "k3": "k2", "k4": "k3"}


def test_policy_and_release(spark, plan):
    model = NearestNeighbors(1).fit(frame(spark, [[0.0], [1.0], [5.0]]))
    assert model.execution_policy_ == plan
    assert model.release().kneighbors().count() == 3


def test_blocks_hold_every_row_once(spark):
    rows = spark.range(200).withColumn("x", F.col("id") * 2)
    found = [sorted(map(tuple, part.collect())) for part in blocks(rows, F.col("id"), 7)]
    assert len(found) == 7 and sorted(r for part in found for r in part) == [(i, 2 * i) for i in range(200)] and max(map(len, found)) < 60


@pytest.mark.parametrize("own", [True, False])
def test_repeated_vectors_are_searched_once(spark, plan, own, monkeypatch):
    """Few rows of every vector are compared, and none of the k nearest is lost."""
    monkeypatch.setattr(nearest, "SPREAD", 1)
    x = np.random.default_rng(5).integers(-2, 3, (400, 1)).astype(float)
    x[x == 0] = -0.0
    x[::7] = np.abs(x[::7])  # both zeros are one place
    q = x if own else np.array([[0.0], [1.5], [9.0]])
    seen = []
    monkeypatch.setattr(nearest, "_searched", lambda *a, f=nearest._searched: seen.append((a[0].count(), a[2][0])) or f(*a))
    model = KNeighborsRegressor(4, weights="distance").fit(frame(spark, x, [float(i) for i in range(400)]))
    found = {r["qid"]: r["prediction"] for r in model.predict(None if own else frame(spark, q)).collect()}
    assert seen == [(5, 25) if own else (3, 20)]
    near = brute(q, x, 4, own=own)
    assert sorted(r[:3] for r in map(tuple, NearestNeighbors(4).fit(frame(spark, x)).kneighbors(None if own else frame(spark, q)).collect())) == [n[:3] for n in near]
    for i in range(len(q)):
        mine = [(d, float(j)) for a, _, j, d in near if a == i]
        w = [float(d == 0) if min(mine)[0] == 0 else 1 / d for d, _ in mine]
        assert found[i] == pytest.approx(sum(a * j for a, (_, j) in zip(w, mine, strict=True)) / sum(w))
