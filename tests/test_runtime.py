import threading

import duckdb
import numpy as np
import pyspark.ml.classification
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from halyard import config, diagnostics, errors, registry, seeds
from halyard.functions.vectors import dot, squared_distance, squared_norm
from halyard.operators.decomposition import PCA
from halyard.operators.kmeans import KMeans
from halyard.operators.linear import LogisticRegression
from halyard.operators.neighbors import NearestNeighbors
from halyard.session import checkpoint_dir, cut, forget
from halyard.sources import tables
from tests.test_neighbors import frame


def test_config_is_local_and_checked():
    with config.config_context(random_state=3) as now:
        assert now.random_state == 3 == seeds.resolve_seed()
        seen = []
        thread = threading.Thread(target=lambda: seen.append(config.get_config().random_state))
        thread.start()
        thread.join()
        assert seen == [None]
    assert config.get_config().random_state is None and seeds.resolve_seed() == 0
    with pytest.raises(errors.UnsupportedParameter):
        config.set_config(device="gpu")
    config.set_config(output_type="pandas")
    config.reset_config()
    assert config.get_config() == config.Config()


def test_tuning_from_environment(monkeypatch):
    monkeypatch.setenv("HALYARD_TILE_VALUES", "77")
    assert config.get_tuning().tile_values == 77
    with config.tuning_context(tile_values=5):
        assert config.get_tuning().tile_values == 5


def test_events(spark):
    diagnostics.clear_backend_diagnostics()
    NearestNeighbors(1).fit(frame(spark, [[0.0], [1.0]])).kneighbors().count()
    assert [e.operation for e in diagnostics.get_backend_diagnostics()] == ["fit", "kneighbors"]
    assert diagnostics.get_last_backend_event().backend == "broadcast_train"
    assert diagnostics.diagnostics_summary()["NearestNeighbors.fit -> dataframe"] == 1
    assert diagnostics.diagnostics_df(spark).count() == 2
    with config.config_context(diagnostics="off"):
        diagnostics.record_event(diagnostics.BackendEvent("a", "b", "c"))
    with config.config_context(diagnostics="warn"), pytest.warns(errors.FallbackWarning):
        diagnostics.record_event(diagnostics.BackendEvent("a", "b", "c", "why", fallback=True))
    for _ in range(600):
        diagnostics.record_event(diagnostics.BackendEvent("a", "b", "c"))
    assert len(diagnostics.get_backend_diagnostics()) == diagnostics.KEPT
    assert diagnostics.device_info()["engine"] == "spark"


def test_errors_are_what_python_expects():
    assert issubclass(errors.UnsupportedParameter, ValueError) and issubclass(errors.SparseInput, TypeError)
    assert issubclass(errors.BackendError, RuntimeError) and issubclass(errors.SparseInput, errors.CapabilityError)
    with pytest.raises(errors.NotFitted):
        KMeans(2).predict(None)


def test_patching_is_reversible():
    before = pyspark.ml.classification.LogisticRegression
    assert registry.patch() == list(registry.DEFAULT)
    assert registry.patch() == []
    assert pyspark.ml.classification.LogisticRegression is LogisticRegression and registry.is_patched("SVC")
    assert registry.unpatch("SVC") == ["SVC"] and not hasattr(pyspark.ml.classification, "SVC")
    assert set(registry.unpatch()) == set(registry.DEFAULT) - {"SVC"}
    assert pyspark.ml.classification.LogisticRegression is before and registry.patched_estimators() == []
    assert registry.load("PCA") is PCA
    with pytest.raises(errors.UnsupportedParameter):
        registry.patch("Nothing")


def test_seeds():
    assert seeds.derive_seed(1, "a", 2) == seeds.derive_seed(1, "a", 2) != seeds.derive_seed(1, "a", 3)
    assert seeds.numpy_generator(1, "x").random() == seeds.numpy_generator(1, "x").random()
    with pytest.raises(ValueError, match="random_state"):
        seeds.resolve_seed(True)


def test_uniform_is_uniform_and_stable(spark):
    rows = spark.range(20_000)
    u = rows.select(seeds.uniform(F.col("id"), 1, "x").alias("u"))
    got = u.agg(F.avg("u"), F.min("u"), F.max("u"), F.stddev("u")).first()
    assert got[0] == pytest.approx(0.5, abs=0.01) and 0 <= got[1] and got[2] < 1 and got[3] == pytest.approx(12**-0.5, abs=0.01)


@pytest.mark.parametrize("d", [3, 100])
def test_vector_expressions(spark, d):
    x = np.random.default_rng(d).normal(size=(4, d))
    y = np.arange(d, dtype=float)
    other = F.array(*[F.lit(v) for v in y.tolist()])
    got = frame(spark, x).select("id", dot(F.col("features"), y), squared_distance(F.col("features"), other, d), squared_norm(F.col("features"), d)).orderBy("id").collect()
    assert np.array(got)[:, 1:] == pytest.approx(np.stack([x @ y, np.square(x - y).sum(1), np.square(x).sum(1)], 1))


def test_estimators_are_pure(spark):
    x = np.random.default_rng(0).normal(size=(40, 3))
    model = PCA(2)
    assert model.clone().get_params() == model.get_params() and repr(model).startswith("PCA(n_components=2")
    one, two = model.clone().fit(frame(spark, x)), model.clone().fit(frame(spark, x, parts=6))
    assert one.components_ == pytest.approx(two.components_, abs=1e-10)
    with pytest.raises(ValueError, match="no parameter"):
        model.set_params(k=3)


def test_models_are_saved(spark, tmp_path):
    rows = frame(spark, np.random.default_rng(0).normal(size=(40, 3)), [0, 1] * 20)
    for model in (PCA(2).fit(rows), KMeans(3).fit(rows), LogisticRegression().fit(rows)):
        path = str(tmp_path / type(model).__name__)
        model.save(spark, path)
        again = type(model).load(spark, path)
        operation = "transform" if isinstance(model, PCA) else "predict"
        one, two = (getattr(m, operation)(rows).orderBy("id").toPandas().iloc[:, -1].tolist() for m in (model, again))
        assert np.array_equal(np.array(one), np.array(two))


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(x % 7, f"n{x}") for x in range(50)], "a int, b string").repartition(5)
    numbered = tables.numbered(rows, ["a", "b"]).collect()
    assert [r["id"] for r in sorted(numbered, key=lambda r: (r["a"], r["b"]))] == list(range(50))
    assert tables.numbered(rows.limit(0), ["a"]).count() == 0
    tables.write(rows, str(tmp_path / "t"), "json")
    assert tables.read(spark, str(tmp_path / "t"), "json").count() == 50
    assert tables.vectors(rows, "b", ["a"]).columns == ["id", "features"]
    edges = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.25)], "src int, dst int, value double")
    assert tables.edges_to_lists(edges).first()["targets"] == [2, 3]


def test_checkpoints_are_deleted(spark):
    import pathlib

    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    held = cut(spark.range(10))
    assert held.count() == 10 and set(folder.rglob("part-*")) > before
    forget(held)
    assert set(folder.rglob("part-*")) == before


def test_checkpoints(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    plan = cut(spark.range(5).selectExpr("id * 2 AS x"))._jdf.queryExecution().toString()
    assert "Range" not in plan


OWN = [n for n in __spark_entry__.queries() if n in __spark_entry__.oracle_sql() and not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "part", "supplier", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_queries_match_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(got.select(*sorted(got.columns)).collect(), key=str)
    b = sorted(want.select(*sorted(want.columns)).fetchall(), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert tuple(x) == pytest.approx(y, abs=2e-5)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_and_devices(spark):
    assert registry.short_name("pyspark.ml.feature.PCA") == "PCA" and "pyspark.ml.feature.PCA" in registry.patch_names()
    with pytest.raises(errors.UnsupportedParameter):
        registry.short_name("pyspark.ml.feature.Bucketizer")
    assert diagnostics.gpu_available() is False
    with diagnostics.use_device(spark.newSession()) as other:
        assert diagnostics.resolve_device() is not None and other is not spark
    assert diagnostics.device_info()["engine"] == "spark"
