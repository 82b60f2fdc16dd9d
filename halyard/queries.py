"""Registered queries of the machine-learning operators, and the SQL that checks them.

Every query runs over whole tables. Numbers are rounded on both sides, for sums depend
on the order of their terms in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.config import tuning_context
from halyard.functions.vectors import dot, squared_distance, squared_norm
from halyard.operators import schedules
from halyard.operators.decomposition import PCA
from halyard.operators.emeans import EMeans, OMeans
from halyard.operators.kmeans import KMeans, plus_plus
from halyard.operators.linear import LogisticRegression, reference_objective
from halyard.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors
from halyard.operators.svm import SVC, kkt_violations, resolve_gamma
from halyard.operators.svm import kernel_sums as sums_of_kernels
from halyard.session import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size and price; sizes are few, so distances tie."""
    scaled = (F.col("p_retailprice") - 1000) / 500
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), scaled.alias("x"), (F.col("p_size") > 25).cast("int").alias("big"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000).alias("features"), F.col("s_nationkey").alias("label"))


# --- neighbours

POINTS = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
PAIRS = POINTS + ", d AS (SELECT q.id AS qid, t.id AS id, t.label, list_distance(q.e, t.e) AS dist FROM p q JOIN p t ON q.id <> t.id)"
NEAREST = f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank FROM d), n AS (SELECT * FROM r WHERE rank <= 5) "
VOTES = NEAREST + ", v AS (SELECT qid, label, sum({w}) AS votes FROM n GROUP BY qid, label) "
PART_PAIRS = """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice AS price FROM part),
d AS (SELECT q.id AS qid, t.id AS id, t.price, abs(q.size - t.size) AS dist FROM p q JOIN p t ON q.id <> t.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d), n AS (SELECT * FROM r WHERE rank <= 7) """


@_query(NEAREST + "SELECT qid, rank, id, round(dist, 6) AS distance FROM n")
def knn_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector, itself left out."""
    return NearestNeighbors(5).fit(_points(spark, sf_dir)).kneighbors().withColumn("distance", F.round("distance", 6))


@_query(f"WITH {POINTS}, d AS (SELECT q.id AS qid, t.id AS id, list_distance(q.e, t.e) AS dist FROM p q, p t), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank FROM d) SELECT qid, rank, id, round(dist, 6) AS distance FROM r WHERE rank <= 3")
def knn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 nearest of every vector as an outside query: the vector itself comes first."""
    points = _points(spark, sf_dir)
    return NearestNeighbors(3).fit(points).kneighbors(points).withColumn("distance", F.round("distance", 6))


@_query(NEAREST + "SELECT qid, rank, id, round(dist, 6) AS distance FROM n")
def knn_self_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the training side is too large to broadcast: queries in blocks, one after the other."""
    with tuning_context(broadcast_bytes=1, block_bytes=1 << 17):
        return NearestNeighbors(5).fit(_points(spark, sf_dir)).kneighbors().withColumn("distance", F.round("distance", 6))


@_query(f"WITH {PAIRS} SELECT qid, id, round(dist, 6) AS distance FROM d WHERE dist <= 1.0")
def radius_self_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors within distance 1 of every vector, in blocks of queries."""
    with tuning_context(broadcast_bytes=1, block_bytes=1 << 17):
        return NearestNeighbors(radius=1.0).fit(_points(spark, sf_dir)).radius_neighbors().withColumn("distance", F.round("distance", 6))


@_query(NEAREST + "SELECT qid AS src, id AS dst, round(dist, 6) AS value FROM n")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of nearest neighbours, weighted by distance."""
    return NearestNeighbors(5).fit(_points(spark, sf_dir)).kneighbors_graph(mode="distance").withColumn("value", F.round("value", 6))


@_query(NEAREST + "SELECT qid AS src, id AS dst, 1.0::DOUBLE AS value FROM n")
def knn_graph_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of nearest neighbours."""
    return NearestNeighbors(5).fit(_points(spark, sf_dir)).kneighbors_graph()


@_query(f"WITH {PAIRS} SELECT qid, id, round(dist, 6) AS distance FROM d WHERE dist <= 1.0")
def radius_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors within distance 1 of every vector."""
    return NearestNeighbors(radius=1.0).fit(_points(spark, sf_dir)).radius_neighbors().withColumn("distance", F.round("distance", 6))


@_query("WITH s AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x FROM supplier) SELECT q.id AS src, t.id AS dst, 1.0::DOUBLE AS value FROM s q JOIN s t ON q.id <> t.id AND (q.x - t.x) * (q.x - t.x) <= 0.25")
def radius_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose balances differ by 500 at most."""
    return NearestNeighbors(radius=0.5).fit(_suppliers(spark, sf_dir)).radius_neighbors_graph()


@_query(VOTES.format(w="1.0") + "SELECT qid, arg_min(label, (-votes, label)) AS prediction FROM v GROUP BY qid")
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of most of the 5 nearest."""
    return KNeighborsClassifier(5).fit(_points(spark, sf_dir)).predict()


@_query(VOTES.format(w="1 / dist") + "SELECT qid, arg_min(label, (-votes, label)) AS prediction FROM v GROUP BY qid")
def knn_classify_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label with most weight by 1 / distance."""
    return KNeighborsClassifier(5, weights="distance").fit(_points(spark, sf_dir)).predict()


@_query(VOTES.format(w="1.0") + "SELECT q.id AS qid, c.label, round(coalesce(votes, 0) / 5, 6) AS probability FROM p q CROSS JOIN (SELECT DISTINCT label FROM p) c LEFT JOIN v ON v.qid = q.id AND v.label = c.label")
def knn_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the 5 nearest for every label."""
    return KNeighborsClassifier(5).fit(_points(spark, sf_dir)).predict_proba().withColumn("probability", F.round("probability", 6))


@_query(f"WITH {POINTS}, d AS (SELECT q.id AS qid, q.label AS truth, t.id AS id, t.label, list_distance(q.e, t.e) AS dist FROM p q, p t), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d), v AS (SELECT qid, truth, label, count(*) AS votes FROM r WHERE rank <= 5 GROUP BY ALL), b AS (SELECT qid, truth, arg_min(label, (-votes, label)) AS prediction FROM v GROUP BY qid, truth) SELECT round(avg((truth = prediction)::INT), 6) AS accuracy FROM b")
def knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the vote on the training vectors."""
    points = _points(spark, sf_dir)
    return spark.createDataFrame([(round(KNeighborsClassifier(5).fit(points).score(points), 6),)], "accuracy double")


@_query(PART_PAIRS + "SELECT qid, round(avg(price), 6) AS prediction FROM n GROUP BY qid")
def knn_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean price of the 7 parts nearest in size; ties go to the smaller key."""
    return KNeighborsRegressor(7).fit(_parts(spark, sf_dir), "price", ["size"]).predict().withColumn("prediction", F.round("prediction", 6))


@_query(PART_PAIRS + ", w AS (SELECT *, CASE WHEN min(dist) OVER (PARTITION BY qid) = 0 THEN (dist = 0)::INT::DOUBLE ELSE 1 / dist END AS w FROM n) SELECT qid, round(sum(w * price) / sum(w), 6) AS prediction FROM w GROUP BY qid")
def knn_regress_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean price, weighted by 1 / distance; parts of the same size alone count where there are some."""
    return KNeighborsRegressor(7, weights="distance").fit(_parts(spark, sf_dir), "price", ["size"]).predict().withColumn("prediction", F.round("prediction", 6))


# --- vector arithmetic

@_query(f"WITH {POINTS} SELECT id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS norm2, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * (i - 1))), 6) AS weighted, round(list_sum(list_transform(e, lambda x: (x - 0.1) * (x - 0.1))), 6) AS d2 FROM p")
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared norm, an inner product, and a squared distance, in generated code."""
    x = F.col("features")
    tenth = F.array(*[F.lit(0.1)] * 64)
    return _points(spark, sf_dir).select("id", F.round(squared_norm(x, 64), 6).alias("norm2"), F.round(dot(x, np.arange(64)), 6).alias("weighted"), F.round(squared_distance(x, tenth, 64), 6).alias("d2"))


# --- k-means and its relatives

def _lloyd(iterations: int) -> str:
    """Lloyd from the vectors 0 to 4 as nested tables: x (points by component), c0, a0, c1, ..."""
    parts = [POINTS, "x AS (SELECT id, unnest(range(1, len(e) + 1)) AS j, unnest(e) AS v FROM p)", "c0 AS (SELECT id AS cid, j, v FROM x WHERE id < 5)"]
    for i in range(iterations + 1):
        parts.append(f"d{i} AS (SELECT x.id, cid, sum((x.v - c.v) * (x.v - c.v)) AS d2 FROM x JOIN c{i} c USING (j) GROUP BY x.id, cid)")
        parts.append(f"a{i} AS (SELECT id, arg_min(cid, (d2, cid)) AS cid, min(d2) AS d2 FROM d{i} GROUP BY id)")
        if i < iterations:
            parts.append(f"c{i + 1} AS (SELECT cid, j, avg(v) AS v FROM a{i} JOIN x USING (id) GROUP BY cid, j)")
    return "WITH " + ", ".join(parts) + " "


def _starts(points: DataFrame) -> list[list[float]]:
    return [list(r["features"]) for r in points.where(F.col("id") < 5).orderBy("id").collect()]


def _lloyd_fit(points: DataFrame, iterations: int) -> KMeans:
    return KMeans(5, init=_starts(points), max_iter=iterations, tol=0.0).fit(points)


def _center_rows(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    rows = [(i, j + 1, round(float(v), 6)) for i, c in enumerate(centers) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "cid long, j long, v double")


@_query(_lloyd(3) + "SELECT cid, j, round(v, 6) AS v FROM c3")
def kmeans_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers after three iterations from given ones."""
    return _center_rows(spark, _lloyd_fit(_points(spark, sf_dir), 3).cluster_centers_)


@_query(_lloyd(2) + "SELECT id, cid::INT AS prediction FROM a2")
def kmeans_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the centers of two iterations."""
    points = _points(spark, sf_dir)
    return _lloyd_fit(points, 2).predict(points).select("id", "prediction")


@_query(_lloyd(2) + "SELECT id, cid, round(sqrt(d2), 6) AS distance FROM d2")
def kmeans_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every vector to the centers of two iterations."""
    points = _points(spark, sf_dir)
    found = _lloyd_fit(points, 2).transform(points)
    return found.select("id", F.posexplode("distances").alias("cid", "distance")).select("id", F.col("cid").cast("long").alias("cid"), F.round("distance", 6).alias("distance"))


@_query(_lloyd(3) + "SELECT round(sum(d2), 6) AS inertia, round(-sum(d2), 6) AS score FROM a3")
def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia of a fresh assignment after three iterations, and the score."""
    points = _points(spark, sf_dir)
    model = _lloyd_fit(points, 3)
    return spark.createDataFrame([(round(model.inertia_, 6), round(model.score(points), 6))], "inertia double, score double")


@_query()
def kmeans_plus_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole fit from k-means++ starts: size and mean squared distance of every cluster."""
    points = _points(spark, sf_dir)
    model = KMeans(10, random_state=7, max_iter=50).fit(points)
    found = model.transform(model.predict(points))
    return found.groupBy("prediction").agg(F.count("*").alias("n"), F.round(F.avg(F.array_min("distances") ** 2), 6).alias("mse"))


@_query("SELECT DISTINCT p_size::DOUBLE AS size FROM part")
def kmeans_plus_plus_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many k-means++ centers as there are different sizes of parts: every size is one."""
    parts = _parts(spark, sf_dir).select("id", F.array("size").alias("features"))
    k = parts.select("features").distinct().count()
    return spark.createDataFrame([(float(c),) for c in plus_plus(parts, k, 1, 3).ravel()], "size double")


@_query("SELECT DISTINCT p_size::DOUBLE AS size FROM part")
def kmeans_plus_plus_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from candidates that are drawn in rounds, as of a table beyond memory."""
    parts = _parts(spark, sf_dir).select("id", F.array("size").alias("features"))
    k = parts.select("features").distinct().count()
    with tuning_context(broadcast_bytes=1):
        return spark.createDataFrame([(float(c),) for c in plus_plus(parts, k, 1, 3).ravel()], "size double")


EMA = _lloyd(1) + ", s AS (SELECT cid, j, sum(v) AS s, count(*) AS n FROM a0 JOIN x USING (id) GROUP BY cid, j) SELECT cid, j, round((0.5 * 1e-10 * c0.v + 0.5 * s) / (0.5 * 1e-10 + 0.5 * n), 6) AS v FROM c0 JOIN s USING (cid, j)"


@_query(EMA)
def emeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One moving-average update by one batch that holds all rows."""
    points = _points(spark, sf_dir)
    model = EMeans(5, max_iter=1, batch_size=10**9, alpha0=0.5, finalization="ema", init=_starts(points), compute_labels=False).fit(points)
    return _center_rows(spark, model.cluster_centers_)


@_query(_lloyd(1) + "SELECT cid, j, round(v, 6) AS v FROM c1")
def emeans_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing means of one pass in one batch."""
    points = _points(spark, sf_dir)
    return _center_rows(spark, EMeans(5, max_iter=1, batch_size=10**9, alpha0=0.5, init=_starts(points), compute_labels=False).fit(points).cluster_centers_)


@_query(_lloyd(1) + "SELECT cid, j, round(v, 6) AS v FROM c1")
def omeans_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing means of one pass in one batch, by two-level search that probes every cell."""
    points = _points(spark, sf_dir)
    model = OMeans(5, max_iter=1, batch_size=10**9, alpha0=0.5, init=_starts(points), n_cells=3, n_probe=3, assignment="two_level", compute_labels=False).fit(points)
    return _center_rows(spark, model.cluster_centers_)


TWO_STEPS = (
    _lloyd(0).rstrip()
    + """, s1 AS (SELECT cid, j, sum(v) AS s, count(*) AS n FROM a0 JOIN x USING (id) GROUP BY cid, j),
m1 AS (SELECT cid, j, 0.5 * 1e-10 + 0.5 * n AS m, (0.5 * 1e-10 * c0.v + 0.5 * s) / (0.5 * 1e-10 + 0.5 * n) AS v FROM c0 JOIN s1 USING (cid, j)),
d1 AS (SELECT x.id, cid, sum((x.v - c.v) * (x.v - c.v)) AS d2 FROM x JOIN m1 c USING (j) GROUP BY x.id, cid),
a1 AS (SELECT id, arg_min(cid, (d2, cid)) AS cid FROM d1 GROUP BY id),
s2 AS (SELECT cid, j, sum(v) AS s, count(*) AS n FROM a1 JOIN x USING (id) GROUP BY cid, j)
SELECT cid, j, round((0.725 * m * m1.v + 0.275 * s) / (0.725 * m + 0.275 * n), 6) AS v FROM m1 JOIN s2 USING (cid, j)"""
)


@_query(TWO_STEPS)
def emeans_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two moving-average updates by whole passes: the step size falls to 0.55 of the first one."""
    points = _points(spark, sf_dir)
    return _center_rows(spark, EMeans(5, max_iter=2, batch_size=10**9, alpha0=0.5, finalization="ema", init=_starts(points), compute_labels=False).fit(points).cluster_centers_)


@_query(TWO_STEPS)
def emeans_two_steps_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with batches that stay in Spark."""
    points = _points(spark, sf_dir)
    with tuning_context(broadcast_bytes=1):
        return _center_rows(spark, EMeans(5, max_iter=2, batch_size=10**9, alpha0=0.5, finalization="ema", init=_starts(points), compute_labels=False).fit(points).cluster_centers_)


@_query(_lloyd(1) + "SELECT cid, j, round(v, 6) AS v FROM c1")
def omeans_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing means of one pass by two-level search that probes one cell of five, a center in each."""
    points = _points(spark, sf_dir)
    model = OMeans(5, max_iter=1, batch_size=10**9, alpha0=0.5, init=_starts(points), n_cells=5, n_probe=1, assignment="two_level", compute_labels=False).fit(points)
    return _center_rows(spark, model.cluster_centers_)


@_query()
def emeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduled fit: sizes of clusters by full search."""
    points = _points(spark, sf_dir)
    model = EMeans(10, max_iter=3, random_state=7).fit(points)
    return model.predict(points).groupBy("prediction").agg(F.count("*").alias("n"))


@_query()
def omeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduled fit with two-level search: sizes of clusters by full search."""
    points = _points(spark, sf_dir)
    model = OMeans(64, max_iter=2, random_state=7, n_cells=16, n_probe=4, assignment="two_level").fit(points)
    return model.predict(points).groupBy("prediction").agg(F.count("*").alias("n"))


_GRID = [(n, k, t) for n in (10_000, 1_000_000, 10_000_000) for k in (64, 16_384) for t in (1, 3)]


@_query(f"""WITH g(n, k, t) AS (VALUES {", ".join(f"({n}::BIGINT, {k}::BIGINT, {t}::BIGINT)" for n, k, t in _GRID)}),
r AS (SELECT *, 0.035 / (CASE WHEN n > 2000000 THEN 8 ELSE 1 END) * k ** 0.13 * n ** 0.88 * t ** 0.81 AS raw FROM g WHERE k <= n),
b AS (SELECT *, least(n, (CASE WHEN raw <= 1 THEN 1 ELSE 2 ** floor(log2(raw) + 0.5) END)::BIGINT) AS batch_size FROM r)
SELECT n, k, t, batch_size, round(least(1.0, 0.824 * k ** -0.46 * batch_size ** 0.90 * n ** -0.45 * t ** -0.11), 6) AS alpha0, (t * ceil(n / batch_size))::BIGINT AS steps FROM b""")
def schedule_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch size, first step and number of steps that the published laws give."""
    rows = []
    for n, k, t in _GRID:
        if k <= n:
            s = schedules.plan(n, k, 64, t)
            rows.append((n, k, t, s.batch_size, round(s.alpha0, 6), sum(s.pass_steps)))
    return spark.createDataFrame(rows, "n long, k long, t long, batch_size long, alpha0 double, steps long")


# --- logistic regression

def _newton(weight: str) -> str:
    """Twelve Newton steps for weight b and intercept a; the weight is penalised with C = 1."""
    return f"""WITH RECURSIVE src AS (SELECT (p_retailprice - 1000) / 500 AS x, (p_size > 25)::INT AS y FROM part),
rows_ AS (SELECT x, y, {weight} AS w FROM src), total AS (SELECT sum(w) AS s FROM rows_),
fit(step, b, a) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, b - (hbb_inv1 * gb + hbb_inv2 * ga), a - (hbb_inv2 * gb + hbb_inv3 * ga) FROM (
    SELECT step, b, a, gb, ga, haa / det AS hbb_inv1, -hab / det AS hbb_inv2, hbb / det AS hbb_inv3 FROM (
      SELECT *, hbb * haa - hab * hab AS det FROM (
        SELECT step, b, a, sum(w * (q - y) * x) / s + b / s AS gb, sum(w * (q - y)) / s AS ga,
               sum(w * q * (1 - q) * x * x) / s + 1 / s AS hbb, sum(w * q * (1 - q) * x) / s AS hab, sum(w * q * (1 - q)) / s AS haa
        FROM (SELECT fit.step, fit.b, fit.a, total.s, x, y, w, 1 / (1 + exp(-(fit.b * x + fit.a))) AS q FROM fit, rows_, total WHERE fit.step < 12)
        GROUP BY step, b, a, s))))
SELECT round(b, 6) AS coef, round(a, 6) AS intercept FROM fit WHERE step = 12"""


def _logistic_row(spark: SparkSession, model: LogisticRegression) -> DataFrame:
    return spark.createDataFrame([(round(float(model.coef_[0, 0]), 6), round(float(model.intercept_[0]), 6))], "coef double, intercept double")


@_query(_newton("1.0"))
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part is big, by its price."""
    return _logistic_row(spark, LogisticRegression(tol=1e-8).fit(_parts(spark, sf_dir), "big", ["x"]))


@_query(_newton("1.0"))
def logistic_fit_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Spark ML and Newton steps on sums of second derivatives, as for a table beyond memory."""
    with tuning_context(broadcast_bytes=1):
        return _logistic_row(spark, LogisticRegression(tol=1e-8).fit(_parts(spark, sf_dir), "big", ["x"]))


@_query("WITH fit AS (" + _newton("1.0").replace("round(b, 6) AS coef, round(a, 6) AS intercept", "b, a") + "), z AS (SELECT p_partkey AS id, b * (p_retailprice - 1000) / 500 + a AS z FROM part, fit) SELECT id, (z > 0)::INT AS prediction, round(z, 5) AS decision, round(1 / (1 + exp(-z)), 5) AS probability FROM z")
def logistic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, score and probability of every part by that fit."""
    parts = _parts(spark, sf_dir)
    model = LogisticRegression(tol=1e-12).fit(parts, "big", ["x"])
    found = model.predict_proba(model.decision_function(model.predict(parts)))
    return found.select("id", "prediction", F.round("decision", 5).alias("decision"), F.round(F.col("probability")[1], 5).alias("probability"))


@_query(_newton("CASE WHEN y = 1 THEN (SELECT count(*) / (2.0 * sum(y)) FROM src) ELSE (SELECT count(*) / (2.0 * sum(1 - y)) FROM src) END"))
def logistic_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with classes of equal weight."""
    return _logistic_row(spark, LogisticRegression(tol=1e-8, class_weight="balanced").fit(_parts(spark, sf_dir), "big", ["x"]))


@_query(_newton("1.0 + abs(x)"))
def logistic_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with sample weights."""
    parts = _parts(spark, sf_dir).withColumn("w", 1 + F.abs("x"))
    return _logistic_row(spark, LogisticRegression(tol=1e-8).fit(parts, "big", ["x"], "w"))


@_query("WITH z AS (SELECT 0.7 * (p_retailprice - 1000) / 500 - 0.2 AS z, (p_size > 25)::INT AS y FROM part) SELECT round(avg(ln(1 + exp(-abs(z))) + greatest(CASE WHEN y = 1 THEN -z ELSE z END, 0)) + 0.49 / (2 * 3.0 * count(*)), 9) AS objective FROM z")
def logistic_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective at given coefficients, C = 3."""
    rows = _parts(spark, sf_dir).select(F.array("x").alias("features"), F.col("big").alias("code"))
    return spark.createDataFrame([(round(reference_objective(rows, [0.7], [-0.2], 3.0), 9),)], "objective double")


@_query()
def logistic_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all vectors by a multinomial fit, with the largest probability."""
    points = _points(spark, sf_dir)
    model = LogisticRegression(max_iter=300, tol=1e-3).fit(points)
    return model.predict(model.predict_proba(points)).select("id", "prediction", F.round(F.array_max("probability"), 6).alias("probability"))


@_query("SELECT grp, label, round(n / sum(n) OVER (PARTITION BY grp), 4) AS probability FROM (SELECT (c_nationkey % 3)::INT AS grp, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL)")
def logistic_multinomial_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multinomial fit without penalty on three groups of customers: probabilities are the shares of the segments in each group."""
    grp = (F.col("c_nationkey") % 3).cast("int")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), grp.alias("grp"), F.array((grp == 1).cast("double"), (grp == 2).cast("double")).alias("features"), F.col("c_mktsegment").alias("label"))
    model = LogisticRegression(penalty=None, tol=1e-9, max_iter=1000).fit(rows)
    asked = spark.createDataFrame([(g, [float(g == 1), float(g == 2)]) for g in range(3)], "grp int, features array<double>")
    names = F.array(*[F.lit(c) for c in model.classes_])
    found = model.predict_proba(asked).select("grp", F.explode(F.arrays_zip(names.alias("label"), F.col("probability"))).alias("p"))
    return found.select("grp", "p.label", F.round("p.probability", 4).alias("probability"))


# --- principal components

@_query(f"WITH {POINTS}, x AS (SELECT id, unnest(range(1, len(e) + 1)) AS j, unnest(e) AS v FROM p) SELECT j, round(avg(v), 6) AS mean FROM x GROUP BY j")
def pca_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the components of all vectors."""
    model = PCA().fit(_points(spark, sf_dir))
    return spark.createDataFrame([(j + 1, round(float(v), 6)) for j, v in enumerate(model.mean_)], "j long, mean double")


@_query(f"WITH {POINTS}, x AS (SELECT id, unnest(range(1, len(e) + 1)) AS j, unnest(e) AS v FROM p) SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 6) AS c FROM x a JOIN x b USING (id) GROUP BY a.j, b.j")
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance that the model with all components describes."""
    c = PCA().fit(_points(spark, sf_dir)).get_covariance()
    return spark.createDataFrame([(i + 1, j + 1, round(float(c[i, j]), 6)) for i in range(len(c)) for j in range(len(c))], "i long, j long, c double")


PLANE = """WITH s AS (SELECT var_samp(p_size) AS a, var_samp(p_retailprice / 50) AS c, covar_samp(p_size, p_retailprice / 50) AS b, avg(p_size) AS mx, avg(p_retailprice / 50) AS my FROM part),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM s),
u AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS uy FROM l),
v AS (SELECT *, CASE WHEN (abs(ux) >= abs(uy) AND ux < 0) OR (abs(ux) < abs(uy) AND uy < 0) THEN -1 ELSE 1 END AS sg FROM u) """


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("id", F.array("size", F.col("price") / 50).alias("features"))


@_query(PLANE + "SELECT p_partkey AS id, round(sg * ((p_size - mx) * ux + (p_retailprice / 50 - my) * uy), 5) AS z FROM part, v")
def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on their first principal axis."""
    plane = _plane(spark, sf_dir)
    return PCA(1).fit_transform(plane).select("id", F.round(F.col("projection")[0], 5).alias("z"))


@_query(PLANE + "SELECT p_partkey AS id, round(sg * ((p_size - mx) * ux + (p_retailprice / 50 - my) * uy) / sqrt(l1), 5) AS z FROM part, v")
def pca_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in units of the axis' standard deviation."""
    plane = _plane(spark, sf_dir)
    return PCA(1, whiten=True).fit_transform(plane).select("id", F.round(F.col("projection")[0], 5).alias("z"))


@_query(PLANE + "SELECT p_partkey AS id, round(mx + ((p_size - mx) * ux + (p_retailprice / 50 - my) * uy) * ux, 5) AS x, round(my + ((p_size - mx) * ux + (p_retailprice / 50 - my) * uy) * uy, 5) AS y FROM part, v")
def pca_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, projected on the first axis and put back."""
    plane = _plane(spark, sf_dir)
    model = PCA(1).fit(plane)
    return model.inverse_transform(model.transform(plane)).select("id", F.round(F.col("reconstruction")[0], 5).alias("x"), F.round(F.col("reconstruction")[1], 5).alias("y"))


@_query(PLANE + ", z AS (SELECT p_partkey AS id, (p_size - mx) * ux + (p_retailprice / 50 - my) * uy AS z1, -(p_size - mx) * uy + (p_retailprice / 50 - my) * ux AS z2, l1, l2 FROM part, v) SELECT id, round(-0.5 * (z1 * z1 / l1 + z2 * z2 / l2 + ln(l1) + ln(l2) + 2 * ln(2 * pi())), 5) AS log_likelihood FROM z")
def pca_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every part under the probabilistic model of one axis and noise."""
    plane = _plane(spark, sf_dir)
    return PCA(1).fit(plane).score_samples(plane).select("id", F.round("log_likelihood", 5).alias("log_likelihood"))


@_query(PLANE + "SELECT round(l1, 5) AS first, round(l1 / (l1 + l2), 6) AS ratio, round(l2, 5) AS noise FROM v")
def pca_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the first axis, its share, and the noise variance."""
    model = PCA(1).fit(_plane(spark, sf_dir))
    return spark.createDataFrame([(round(float(model.explained_variance_[0]), 5), round(float(model.explained_variance_ratio_[0]), 6), round(model.noise_variance_, 5))], "first double, ratio double, noise double")


# --- support vector machines

@_query(f"WITH {POINTS}, x AS (SELECT unnest(e) AS v FROM p) SELECT round(1 / (64 * var_pop(v)), 9) AS gamma FROM x")
def svc_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel width that the data's variance gives."""
    return spark.createDataFrame([(round(resolve_gamma(_points(spark, sf_dir), "scale", 64), 9),)], "gamma double")


@_query("WITH s AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x FROM supplier) SELECT a.id, round(sum(exp(-0.5 * (a.x - b.x) * (a.x - b.x))), 6) AS rbf, round(sum((0.1 * a.x * b.x + 1) ** 2), 4) AS poly, round(sum(tanh(0.01 * a.x * b.x)), 6) AS sigmoid, round(sum(a.x * b.x), 4) AS linear FROM s a, s b GROUP BY a.id")
def kernel_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of four kernels between every supplier and all of them."""
    kernels = {"rbf": {"kernel": "rbf", "gamma": 0.5}, "poly": {"kernel": "poly", "gamma": 0.1, "degree": 2, "coef0": 1.0}, "sigmoid": {"kernel": "sigmoid", "gamma": 0.01}, "linear": {"kernel": "linear"}}
    found = sums_of_kernels(_suppliers(spark, sf_dir), 1, kernels)
    return found.select("id", *(F.round(name, d).alias(name) for name, d in zip(kernels, (6, 4, 6, 4), strict=True)))


@_query("SELECT p::INT AS pair, 0::BIGINT AS violations FROM range(45) t(p)")
def svc_kkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that violate the optimality conditions, for every pair of labels: none may."""
    points = _points(spark, sf_dir)
    return kkt_violations(SVC(C=1.0, tol=1e-3).fit(points), points, slack=1e-6)


BANDS = """WITH s AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, CASE WHEN c_acctbal < 2500 THEN 0 WHEN c_acctbal BETWEEN 3500 AND 6000 THEN 1 WHEN c_acctbal > 7000 THEN 2 END AS label FROM customer),
e AS (SELECT max(x) FILTER (label = 0) AS a, min(x) FILTER (label = 1) AS b, max(x) FILTER (label = 1) AS c, min(x) FILTER (label = 2) AS d FROM s) """


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    label = F.when(balance < 2500, 0).when(balance.between(3500, 6000), 1).when(balance > 7000, 2)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(balance / 1000).alias("features"), label.alias("label"))


@_query(BANDS + "SELECT id, CASE WHEN x < (a + b) / 2 THEN 0 WHEN x < (c + d) / 2 THEN 1 ELSE 2 END AS prediction FROM s, e")
def svc_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands of balances that a linear kernel parts: labels of all customers, those between the bands too."""
    rows = _bands(spark, sf_dir)
    return SVC(C=1e5, kernel="linear", tol=1e-8).fit(rows.where("label IS NOT NULL")).predict(rows).select("id", "prediction")


@_query(BANDS + "SELECT id, round((x - (a + b) / 2) * 2 / (b - a), 4) AS decision FROM s, e")
def svc_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of the lower two of those bands: -1 and 1 at the margins."""
    rows = _bands(spark, sf_dir)
    model = SVC(C=1e5, kernel="linear", tol=1e-8).fit(rows.where("label < 2"))
    return model.decision_function(rows).select("id", F.round("decision", 4).alias("decision"))


@_query()
def svc_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all vectors by an exact fit."""
    points = _points(spark, sf_dir)
    return SVC(C=1.0).fit(points).predict(points).select("id", "prediction")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
