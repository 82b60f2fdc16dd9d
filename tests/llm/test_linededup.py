import random

import numpy as np
import pytest

from halyard.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(text, edits, rng, letters="abcdefgh é漢"):
    out = list(text)
    for _ in range(edits):
        kind, i = rng.randint(0, 2), rng.randint(0, len(out))
        if kind == 0:
            out.insert(i, rng.choice(letters))
        elif i < len(out):
            if kind == 1:
                del out[i]
            else:
                out[i] = rng.choice(letters)
    return "".join(out)


def codes(text):
    return np.array([ord(c) for c in text], np.int64)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("ab é") for _ in range(rng.randint(0, 14)))
        b, limit = edited(a, rng.randint(0, 4), rng, "abc"), rng.randint(0, 4)
        assert linededup.edit_distance(codes(a), codes(b), limit) == min(distance(a, b), limit + 1), (a, b, limit)


def test_many_pairs_at_once():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    texts += [edited(rng.choice(texts), rng.randint(0, 40), rng, "abc") for _ in range(150)]
    pairs = np.array([(rng.randrange(150), rng.randrange(300)) for _ in range(3000)])
    limit = np.array([rng.choice([0, 1, 2, 5, 9, 20, 31, 32, 45]) for _ in pairs])
    found = linededup.within([codes(t).astype(np.int32) for t in texts], *pairs.T, limit)
    for (a, b), most, ok in zip(pairs, limit, found, strict=True):
        assert ok == (a == b or abs(len(texts[a]) - len(texts[b])) <= most and linededup.edit_distance(codes(texts[a]), codes(texts[b]), int(most)) <= most)
    for (a, b), most, ok in list(zip(pairs, limit, found, strict=True))[:300]:
        assert ok == (distance(texts[a], texts[b]) <= most)


def test_classes_of_lengths_differ_by_one():
    for per_word in (8, 12, 30):
        rule = linededup.Rule(per_word=per_word)
        n = np.unique(np.r_[np.arange(per_word, 5000), np.geomspace(5000, 10**7, 4000).astype(int)])
        assert (rule.size(n) - rule.size(np.maximum(per_word, n - n // per_word)) <= 1).all()
        assert (rule.reach(rule.size(n)) >= n // per_word + linededup.RUN).all() and rule.size(10**7) < 256


def test_edit_distance_of_wide_bands():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        b, limit = edited(a, rng.randint(0, 30), rng, "abc"), rng.randint(0, 40)
        assert linededup.edit_distance(codes(a), codes(b), limit) == min(distance(a, b), limit + 1), (a, b, limit)


RULE = linededup.Rule(per_word=12)
VOCABULARY = [a + b for a in "abcdeé" for b in ("", "x", "yy", "漢")]


def met(lines, one, other, rule=RULE, frequent=linededup.NONE_FREQUENT):
    """Whether two lines meet at a key, one filed and the other probing, and may link there."""
    line, key, sketch = linededup.keys(lines, rule, frequent)
    h1 = np.array([one, other])[(line == other).astype(int)]
    mine = (line == one) | (line == other)
    key, h1, sketch = key[mine].view(np.int64), h1[mine], sketch[mine].view(np.int64)
    order = np.argsort(key, kind="stable")
    own = key[order] >> linededup.HASH
    found, _ = linededup._meet(np.cumsum(np.r_[0, own[1:] != own[:-1]]), key[order], h1[order], sketch[order], rule, float("inf"))
    return len(found) > 0


def test_linking_lines_of_characters_meet():
    rng, met_any = random.Random(2), 0
    for _ in range(600):
        a = "".join(rng.choice("abcdefgh é漢") for _ in range(rng.randint(16, 70)))
        b = edited(a, rng.randint(1, 2), rng)
        limit = int(RULE.chars(min(len(a), len(b))))
        if a == b or not limit or distance(a, b) > limit or min(len(a.split()), len(b.split())) >= 12:
            continue
        met_any += 1
        assert met(["z" * 20, a, "q" * 17, b], 1, 3), (a, b)
    assert met_any > 100


def edited_words(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        kind, i = rng.randint(0, 2), rng.randint(0, len(out))
        if kind == 0:
            out.insert(i, rng.choice(VOCABULARY))
        elif i < len(out):
            if kind == 1:
                del out[i]
            else:
                out[i] = rng.choice(VOCABULARY)
    return out


def test_linking_lines_of_words_meet():
    rng, met_any = random.Random(4), 0
    for _ in range(1500):
        a = [rng.choice(VOCABULARY) for _ in range(rng.choice([12, 13, 17, 23, 24, 25, 40, 61, 90, 150, 250, 700, 1030, 1100]))]
        b = edited_words(a, rng.randint(1, len(a) // 12), rng)
        n = min(len(a), len(b))
        number = {w: i for i, w in enumerate(VOCABULARY)}
        x, y = (np.array([number[w] for w in s]) for s in (a, b))
        if a == b or n < 12 or linededup.edit_distance(x, y, n // 12) > n // 12:
            continue
        met_any += 1
        lines = ["one two", " ".join(a), "x " * 30, "\u3000".join(b)]
        some = np.unique(rng.sample(linededup.Grams.of(lines).hash.tolist(), len(a) // 2)).astype(np.uint64)
        assert met(lines, 1, 3), (len(a), len(b))
        assert met(lines, 1, 3, frequent=(some, np.arange(len(some)) % 15 + 1)), (len(a), len(b))
    assert met_any > 800


def brute_lines(rows, per_word=None, max_edits=2, per_edit=16):
    """Of every line: doc_id, line_no, place of its class, links, whether kept, and the line; by comparing all pairs of lines."""
    places = [(i, k, line) for i, t, *_ in rows for k, line in enumerate((t or "").split("\n")) if line and not line.isspace()]
    lines = list(dict.fromkeys(line for *_, line in places))
    root, links = {x: x for x in lines}, dict.fromkeys(lines, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            one, two, limit = a, b, min(max_edits, min(len(a), len(b)) // per_edit)
            if per_word and min(len(a.split()), len(b.split())) >= per_word:
                one, two = a.split(), b.split()
                limit = min(len(one), len(two)) // per_word
            if limit and abs(len(one) - len(two)) <= limit and distance(one, two) <= limit:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for i, k, line in places:
        if i is not None:
            first[find(line)] = min(first.get(find(line), (i, k)), (i, k))
    return [(i, k, *first.get(find(line), (None, None)), links[line], first.get(find(line)) == (None if i is None else (i, k)), line) for i, k, line in places]


def brute(rows, per_word=None):
    return sorted((x[:-1] for x in brute_lines(rows, per_word)), key=str)


def plain_lines(rows, per_word=None):
    """Ids and texts without the lines that are not the first of their class."""
    gone = {(i, k, line) for i, k, *_, kept, line in brute_lines(rows, per_word) if not kept and i is not None}
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k, x) not in gone)) for i, t, *_ in rows]


def fixture(ids=range(120)):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(14, 60))) for _ in range(40)]
    texts = [[rng.choice(VOCABULARY) for _ in range(n)] for n in (10, 11, 12, 13, 20, 24, 30, 36, 50, 70)]
    rows = []
    for i in ids:
        own = [edited(rng.choice(base), rng.choice([0, 0, 1, 2, 3]), rng) for _ in range(rng.randint(0, 4))]
        own += [rng.choice([" ", "  "]).join(edited_words(w, rng.randint(0, len(w) // 11 + 1), rng)) for w in rng.choices(texts, k=rng.randint(0, 3))]
        rows.append((i, "\n".join(own), "en", "s"))
    return rows


@pytest.mark.parametrize("per_word", [None, 12])
def test_classes_match_brute_force(docs, per_word):
    rows = fixture()
    assert sorted(map(tuple, linededup.classes(docs(rows), per_word=per_word).collect()), key=str) == brute(rows, per_word)


@pytest.mark.parametrize("per_word", [None, 12])
def test_crowded_keys_are_split_without_loss(docs, monkeypatch, per_word):
    rows = fixture()
    monkeypatch.setattr(linededup, "CROWD", 3)
    monkeypatch.setattr(linededup, "PART", 2)
    assert sorted(map(tuple, linededup.classes(docs(rows), per_word=per_word).collect()), key=str) == brute(rows, per_word)


def test_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    assert sorted(map(tuple, linededup.classes(frame).collect()), key=str) == brute(odd_rows)
    out = linededup.deduplicate(frame)
    assert out.columns == frame.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(plain_lines(odd_rows), key=str)
    assert out.count() == len(odd_rows)
    assert texts[5] == "one two three"
    assert texts[6] == ""
    assert texts[1] is None
    assert texts[9] == "a\nb\r\n\n\x0bc"
    assert linededup.classes(docs([])).count() == 0
    assert linededup.deduplicate(docs([])).count() == 0


@pytest.mark.parametrize("per_word", [None, 12])
def test_deduplicate_matches_brute_force(docs, per_word):
    rows = fixture()
    found = linededup.deduplicate(docs(rows), per_word=per_word).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(plain_lines(rows, per_word))
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_repeated_ids_with_different_texts_lose_no_line(docs):
    """A line that is nowhere else stays, though another row of its id loses the line at its place."""
    line, unique, other = "a line that two documents hold", "a line that is nowhere else at all", "x y z, some third thing entirely"
    rows = [(1, line), (7, unique), (7, line), (7, f"{other}\n{unique}"), (8, unique), (None, line), (None, f"{other}\nzz")]
    rows = [(*r, "en", "s") for r in rows] + [(i, t, "en", "s") for i, t, *_ in fixture(i // 3 for i in range(60))]
    found = linededup.deduplicate(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(plain_lines(rows), key=str)
    assert (7, unique) in {(r["doc_id"], r["text"]) for r in found}


def test_ids_of_any_type(docs):
    from pyspark.sql import functions as F

    rows = fixture()
    frame = docs(rows).withColumn("doc_id", F.concat(F.lit("doc-"), F.lpad("doc_id", 5, "0")))
    named = [(f"doc-{i:05}", t) for i, t, *_ in rows]
    assert sorted(map(tuple, linededup.classes(frame).collect()), key=str) == brute(named)
    assert sorted(map(tuple, linededup.deduplicate(frame).select("doc_id", "text").collect())) == sorted(plain_lines(named))


@pytest.mark.parametrize("per_word", [None, 12])
def test_rows_of_one_key_beyond_memory_are_split(docs, monkeypatch, per_word):
    rows = fixture()
    monkeypatch.setattr(linededup, "MOST", 6)
    monkeypatch.setattr(linededup, "PART", 2)
    monkeypatch.setattr(linededup, "SAMPLE", 30)
    assert sorted(map(tuple, linededup.classes(docs(rows), per_word=per_word).collect()), key=str) == brute(rows, per_word)


def test_a_part_of_probing_rows_alone_has_no_pairs(spark, monkeypatch):
    """A part beyond memory into which no filed row was dealt, before and between others."""
    monkeypatch.setattr(linededup, "MOST", 3)
    rows = [(key << linededup.HASH | linededup.PROBES, 100 * key + n, 0, 0) for key in (1, 3) for n in range(9)]
    rows += [(2 << linededup.HASH, 7, 0, 0), *((2 << linededup.HASH | linededup.PROBES, n, 0, 0) for n in range(9))]
    dealt = spark.createDataFrame(rows, "key long, h1 long, sketch long, part int").coalesce(1).sortWithinPartitions("part", "key", "h1")
    found = linededup._meeting(dealt, RULE, float("inf")).select("u", "v").distinct().collect()
    assert sorted(map(tuple, found)) == [(min(n, 7), max(n, 7)) for n in range(9) if n != 7]


def test_keys_of_short_lines():
    line, *_ = linededup.keys(["x" * 16], RULE)
    assert len(line) and np.all(line == 0)
    assert not len(linededup.keys(["x" * 15, "a b c"], RULE)[0])
