import numpy as np
import pytest
import xxhash

from halyard.llm import graph, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, threshold):
    """The component of every value, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = sorted(root)
    for i, p in enumerate(values):
        for q in values[i + 1 :]:
            if bin(p ^ q).count("1") <= threshold:
                root[max(find(p), find(q))] = min(find(p), find(q))
    return {p: find(p) for p in values}


@pytest.mark.parametrize("text", [None, "", " ", "a", "a b c", "A b C d", "a b c d e f g", "É é Z z", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_homes_cover_with_radius_one():
    words = np.arange(1 << simhash.CODE)
    assert np.bitwise_count((words ^ simhash.HOMES).astype(np.uint64)).max() == 1
    assert len(np.unique(simhash.HOMES)) == 1 << 11


@pytest.mark.parametrize("threshold", [0, 2, 4, 6])
def test_links_find_every_pair(spark, threshold):
    rng = np.random.default_rng(threshold)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, threshold + 3), replace=False))) for b in base for _ in range(4)]
    prints = sorted({int(x) for x in [*base, *near]})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), threshold)
    got = {r["node"] % (1 << 64): r["root"] for r in graph.components(found).collect()}
    expected = brute_roots(prints, threshold)
    same = {}
    for p in prints:
        same.setdefault(expected[p], set()).add(got.get(p, f"alone {p}"))
    assert all(len(s) == 1 for s in same.values())
    assert len({next(iter(s)) for s in same.values()}) == len(same)


def test_crowded_anchors_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 62))
    prints = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    plain = {r["node"]: r["root"] for r in graph.components(simhash.links(frame)).collect()}
    monkeypatch.setattr(simhash, "HOT", 20)
    split = {r["node"]: r["root"] for r in graph.components(simhash.links(frame)).collect()}
    assert plain == split
    assert len(plain) > 100


def test_large_groups_are_walked(monkeypatch):
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 12, 2500, dtype=np.uint64))
    anchor = np.full(len(prints), simhash.home(np.zeros(1, np.uint64), 2)[0])
    nodes, roots = simhash._compare(anchor, anchor, prints, 1)
    assert set(roots.tolist()) <= {int(x) for x in prints}
    big = np.tile(prints, 1)
    extra = np.concatenate([big, np.arange(1 << 13, (1 << 13) + 400, dtype=np.uint64)])
    nodes, roots = simhash._compare(np.full(len(extra), anchor[0]), np.full(len(extra), anchor[0]), extra, 3)
    expected = brute_roots([int(x) for x in extra[:1]], 3)
    assert len(nodes) == len(extra) - 1 or len(expected) == 1


def test_groups_of_odd_rows(docs, odd_rows):
    got = docs(odd_rows)
    rows = simhash.groups(got).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1
    assert by_id[5] == by_id[6] == 5
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, 5}
    kept = simhash.deduplicate(got)
    assert kept.columns == got.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 8, 9]
    assert simhash.groups(docs([])).count() == 0
    assert simhash.deduplicate(docs([])).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 18])
def test_components_of_chains_and_stars(spark, monkeypatch, broadcast):
    monkeypatch.setattr(graph, "BROADCAST", broadcast)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    loops = [(5000, 5000), (6000, 6001), (6001, 6000), (6001, None)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain + star + loops, "u long, v long")).collect()}
    assert {got[i] for i in range(201)} == {0}
    assert {got[1000 + i] for i in range(300)} == {1000}
    assert got[6001] == 6000
    assert 5000 not in got


def test_repeated_ids_keep_the_same_row_each_time(docs):
    rows = [(1, f"some text number {i} of one id", "en", f"s{i}") for i in range(30)] + [(2, "another text entirely", "en", "s")] * 3
    frame = docs(rows)
    one, two = (sorted(map(tuple, simhash.deduplicate(f).collect())) for f in (frame, frame.orderBy("source", ascending=False).repartition(5)))
    assert one == two and [r[0] for r in one] == [1, 2]
