"""The corpus pipeline against a plain version of itself."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from halyard.llm import quality, queries, tokens
from tests.llm.test_linededup import distance
from tests.llm.test_packing import checked
from tests.llm.test_simhash import brute_print, brute_roots

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_lines(rows):
    """Texts without lines of which an equal or nearly equal one came before."""
    lines = list(dict.fromkeys(line for _, t in rows for line in t.split("\n") if line and not line.isspace()))
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def few(one, two, limit):
        """Whether so few edits make one of the other: first by what they hold, then exactly."""
        both = Counter(one)
        both.subtract(two)
        return abs(len(one) - len(two)) <= limit and sum(map(abs, both.values())) <= 2 * limit and distance(one, two) <= limit

    by_length = sorted(lines, key=len)
    for n, a in enumerate(by_length):
        limit = min(2, len(a) // 16)
        for b in by_length[n + 1 :]:
            if len(b) - len(a) > limit or not limit:
                break
            if few(a, b, limit):
                root[find(b)] = find(a)
    seen, out = set(), []
    for i, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            if line and not line.isspace():
                if find(line) in seen:
                    continue
                seen.add(find(line))
            kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


def test_run_matches_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    good = quality.score(docs, quality.fit(docs)).where("quality_score >= 0.5").join(docs, "doc_id")
    rows = plain_lines([(r["doc_id"], r["text"]) for r in good.collect()])
    prints = {i: brute_print(t) for i, t in rows}
    roots = brute_roots(prints.values(), 4)
    first = {}
    for i, _ in sorted(rows):
        first.setdefault(roots[prints[i]], i)
    rows = [(i, t, of[i]) for i, t in rows if i in first.values()]

    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string, source string").toArrow())
    mixed = []
    texts = {i: t for i, t, _ in rows}
    for i, size, _, _, taken in con.sql(queries.OP2).fetchall():
        words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", texts[i])
        mixed += [(i, texts[i])] * (taken // size if size else 1)
        if size and taken % size:
            mixed.append((i, "".join(words[: taken % size])))
    tokenizer = Tokenizer.from_file(tokens.public("byte_bpe_50k.json"))
    expected = []
    for i, t in mixed:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        begins = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
            expected.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))

    found = corpus_pipeline.run(spark, SF).toPandas()
    got = list(found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert sorted(got) == sorted(expected)
    assert checked(found) <= -(-found.length.sum() // 1024) * 1.02 + 2


def test_stages_keep_the_columns_of_documents(spark, docs, odd_rows):
    for rows in (odd_rows, []):
        frame = docs(rows).select(*COLUMNS)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == COLUMNS
                frame = spark.createDataFrame(out.collect(), docs([]).select(*COLUMNS).schema)
            out.count()


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]


@pytest.mark.parametrize("number", range(1, 11))
def test_every_operator_is_registered(number):
    assert sum(name.startswith(f"op{number}_") for name in __spark_entry__.queries()) == 1
    assert "pipeline" in __spark_entry__.queries()
