import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, fp string, component_id string, row string, label string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents with extra columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "a", "b", "c", "d", "e", "f") for i, t, lang, source in rows]
        return spark.createDataFrame(full, KIND)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = "wort " * 30_000
    return [
        (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \t\n ", None, None), (4, long, "de", "s1"), (4, long, "de", "s1"), (5, "one two three", "en", None), (None, "one two three", "en", "s1"),
        (6, "one two three", None, "s0"), (7, "É à ü ß 漢字   x", "fr", "s0"), (8, "12 345 --- %%%", "en", "s2"), (None, None, None, None), (9, "a\nb\r\n\n\x0bc", "en", "s2"),
    ]
