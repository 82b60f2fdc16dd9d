import random

import numpy as np
import pytest

import corpus_pipeline
from halyard.llm import jaccard, simhash
from tests.llm.test_simhash import brute_print, brute_roots


def similarity(a, b, width=5):
    one, two = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / max(1, len(one | two))


def fixture():
    """Texts, near copies with a few words changed, a boilerplate that a third share, copies, short and empty texts."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=rng.randint(5, 120)) for _ in range(50)]
    common = rng.choices(words, k=40)
    texts = ["", " ", None, "one two", "One  two", "one two three"]
    for i in range(200):
        own = list(rng.choice(base)) + (common if i % 3 == 0 else [])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


def brute(rows):
    """Kept doc_ids by comparing all pairs."""
    prints = {i: brute_print(t) for i, t, *_ in rows}
    roots = brute_roots(prints.values(), 4)
    root = {i: roots[prints[i]] for i in prints}
    texts = [(i, t) for i, t, *_ in rows if t and t.strip()]
    linked = 0
    for n, (i, a) in enumerate(texts):
        for j, b in texts[n + 1 :]:
            if similarity(a, b) >= 0.8 and root[i] != root[j]:
                linked += 1
                old = root[j]
                root = {k: root[i] if r == old else r for k, r in root.items()}
    first = {}
    for i in sorted(root):
        first.setdefault(root[i], i)
    return sorted(first.values()), linked


@pytest.mark.parametrize("crowd", [256, 3])
def test_near_dedup_finds_all_pairs_of_five_word_jaccard(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "PART", 4 if crowd == 3 else 2048)
    rows = fixture()
    kept, linked = brute(rows)
    assert linked >= 10
    found = corpus_pipeline.near_dedup(spark, docs(rows).repartition(5), "")
    assert sorted(r["doc_id"] for r in found.collect()) == kept


def test_alike_sets_meet_in_any_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5, 9, 10, 50, 333):
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = len(one) - int(jaccard.least(len(one), 0.8))
        two = np.sort(rng.permutation(one)[gone:])
        assert jaccard.alike(one, two, 0.8)
        frequent = np.sort(rng.permutation(one)[: len(one) // 2])
        count = rng.integers(3, 9, len(frequent))
        begin = [set(jaccard.ordered(x, frequent, count)[: len(x) - int(jaccard.least(len(x), 0.8)) + 1].tolist()) for x in (one, two)]
        assert begin[0] & begin[1]


def test_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    assert jaccard.links(frame).count() == 0
    assert jaccard.links(docs([])).count() == 0
    assert simhash.deduplicate(frame, more=jaccard.links(frame)).count() == simhash.deduplicate(frame).count()


def test_the_sample_grows_with_the_table():
    """A shingle of CROWD documents is known to be frequent in a table of any size."""
    for n in (1, 8000, 10**6, 10**9):
        assert jaccard.sample_size(n) >= jaccard.SAMPLE
        assert jaccard.sample_size(n) * jaccard.CROWD >= 2 * jaccard.FREQUENT * n


def test_few_shingles_are_known_and_no_link_is_lost(docs, monkeypatch):
    """In a small sample of a crowded table, and with room for the most frequent shingles alone."""
    rows = fixture()
    found = []
    for known in (1 << 20, 5, 0):
        for name, value in (("SAMPLE", 20), ("CROWD", 12), ("KNOWN", known)):
            monkeypatch.setattr(jaccard, name, value)
        found.append(sorted(tuple(sorted((r["u"], r["v"]))) for r in jaccard.links(docs(rows)).collect()))
    assert found[0]
    components = [simhash.local_roots(*np.array(f).T) for f in found]
    assert all(np.array_equal(a, b) for c in components[1:] for a, b in zip(components[0], c, strict=True))
