import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import mixing, queries


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_water_filling_is_feasible_and_fair(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    targets = mixing.water_fill(sizes, weights, sum(sizes), 3)
    assert np.all(targets <= 3 * np.array(sizes) + 1e-6)
    assert targets.sum() == pytest.approx(sum(sizes), rel=1e-9, abs=1e-6)
    free = targets < 3 * np.array(sizes) - 1e-6
    levels = (targets / weights)[free]
    if len(levels):  # all that are not clamped have one level, which no clamped one exceeds
        assert levels.max() - levels.min() < 1e-6 * max(1, levels.max())
        assert np.all((targets / weights)[~free] <= levels.max() + 1e-6 * max(1, levels.max()))


def test_odd_rows_match_sql_and_reruns_agree(spark, docs, odd_rows):
    frame = docs(odd_rows)
    got = sorted(map(tuple, mixing.plan(frame).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    again = sorted(map(tuple, mixing.plan(frame.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text", "source").toArrow())
    expected = sorted(con.sql(queries.OP2).fetchall(), key=str)
    assert got == again
    assert got == expected


def test_taken_words_meet_targets(docs):
    rows = [(i, "w " * (i % 37), "en", f"s{i * i % 5}") for i in range(400)]
    found = mixing.plan(docs(rows)).toPandas()
    by_source = found.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by_source.taken - by_source.target) <= 1).all()
    assert (found.taken <= 3 * found["size"]).all()


def test_materialized_words_are_the_taken_ones(docs):
    rows = [(i, f" {i}a\tb  c\n" * (i % 7 + 1), "en", f"s{i % 4}") for i in range(60)]
    frame = docs(rows)
    plan = mixing.plan(frame).toPandas().set_index("doc_id")
    out = mixing.materialize(frame)
    assert out.columns == frame.columns
    got = out.toPandas()
    got["words"] = got.text.str.split().str.len()
    assert got.groupby("doc_id").words.sum().to_dict() == {i: n for i, n in plan.taken.items() if n}
    assert (got.n_chars == got.text.str.len()).all()


def test_empty_table(docs):
    assert mixing.plan(docs([])).count() == 0
    assert mixing.materialize(docs([])).count() == 0


def test_words_are_counted_between_ascii_spaces_only(docs):
    assert [r["size"] for r in mixing.plan(docs([(1, "a b c d", "en", "s")])).collect()] == [2]


def test_many_sources_are_shared_out_in_rounds(docs, odd_rows, monkeypatch):
    rows = odd_rows + [(i, "w " * (i * i % 91), "en", f"s{i * i % 40}") for i in range(20, 500)] + [(900, "w " * 5000, "en", None), (901, "w " * 3000, "en", "s7")]
    frame = docs(rows)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    want = sorted(map(tuple, mixing.plan(frame).select(*columns).collect()), key=str)
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 3)
    assert sorted(map(tuple, mixing.plan(frame).select(*columns).collect()), key=str) == want
    assert mixing.plan(docs([])).count() == 0
