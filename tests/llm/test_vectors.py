import math

import numpy as np
import pytest

from halyard.llm import ann, topk

NAN, INF = float("nan"), float("inf")
ODD = [(1, [1.0, 2.0]), (2, None), (3, [NAN, 1.0]), (4, [INF, 0.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, []), (8, [1.0]), (9, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (10, [1.0, 2.0]), (10, [2.0, 1.0]), (11, [-3.0, 0.5]), (12, [1e30, -1e30])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int, score double")


def usable(rows):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def first_by_id(rows):
    found = {}
    for i, v in rows:
        found[i] = min(found.get(i, v), v)
    return found


def brute_topk(rows, k, scale=64):
    rows = usable(rows)
    whole = lambda v: [math.floor(scale * x) for x in v]
    out = []
    for q, v in first_by_id(rows).items():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole(v), whole(w), strict=False)))), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_topk_of_odd_rows(spark, k):
    vectors = frame(spark, ODD)
    assert sorted(map(tuple, topk.search(vectors, vectors, k).collect())) == brute_topk(ODD, k)


def test_topk_with_ties_over_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SCORES", 64)
    rng = np.random.default_rng(0)
    rows = [(i, [0.5, 0.25, 0.0] if i % 3 == 0 else rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(240)]
    vectors = frame(spark, rows).repartition(7)
    assert sorted(map(tuple, topk.search(vectors, vectors.where("vec_id % 5 = 0"), 6).collect())) == sorted(r for r in brute_topk(rows, 6) if r[0] % 5 == 0)


def test_empty_tables(spark):
    vectors, nothing = frame(spark, ODD), frame(spark, [])
    for search in (topk.search, ann.search):
        assert search(nothing, nothing).count() == 0
        assert search(vectors, nothing).count() == 0
        assert search(nothing, vectors).count() == 0


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_ann_of_odd_rows_is_exact_where_all_lists_are_searched(spark):
    rows = [(i, v) for i, v in usable(ODD) if any(v)]
    found = {}
    for r in ann.search(frame(spark, ODD), frame(spark, ODD), 3).collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, v in first_by_id(rows).items():
        want = sorted(((i, cosine(v, w)) for i, w in rows if i != q), key=lambda x: (-round(x[1], 12), x[0]))[:3]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want], abs=1e-12)


def test_ann_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 100)
    monkeypatch.setattr(ann, "ASKED", 7)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0"), 5).toPandas()
    table = vectors.toPandas()
    x = np.stack(table.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = table.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(found[found.query_id == q].vec_id))
        total += 5
    assert hits / total >= 0.9
    assert (found.groupby("query_id")["rank"].max() == 5).all()


def test_ann_recall_over_a_thousand_lists(spark, monkeypatch):
    """Random directions, whose neighbours are spread over far more lists than a search front holds."""
    monkeypatch.setattr(ann, "LIST", 8)
    x = ann._unit(np.random.default_rng(5).normal(size=(10_400, 64)))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert len(ann.fit(vectors).centroids) > 1000
    found = {}
    for r in ann.search(vectors, vectors.where("vec_id % 100 = 0"), 5).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 10_400, 100):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & found.get(q, set()))
    assert hits / (5 * 104) >= 0.9


def test_lists_are_balanced_and_the_graph_finds_them():
    rng = np.random.default_rng(2)
    x = ann._unit(np.concatenate([rng.normal(size=(2000, 16)), np.tile(rng.normal(size=(1, 16)), (1000, 1))]))
    centroids = ann.balanced(x, 32, rng)
    index = ann.Index(centroids, *ann.graph(centroids, rng), 1.2)
    ids, far = ann.walk(x[:500], index)
    assert (ids[:, 0] == (x[:500] @ centroids.T).argmax(1)).mean() > 0.97
    rows, lists = ann.lists_of(x[:500], index)
    assert len(rows) > 500 and set(rows.tolist()) == set(range(500))
