import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import langid, quality, toxicity
from halyard.llm.terms import held_out

SF = "/root/testdata/sf0.01"


# --- toxicity


def test_pairs_count_for_more_than_their_parts():
    """Toxic only if an insult meets a group: additive weights cannot tell."""
    rng = np.random.default_rng(0)
    sets, label = [], []
    for _ in range(3000):
        insult, group = rng.random(2) < 0.4
        noise = rng.choice(np.arange(2, 12), 3, replace=False)
        sets.append(np.r_[[0] * int(insult), [1] * int(group), noise].astype(int))
        label.append(int(insult and group))
    label = np.array(label)
    row, place = np.repeat(np.arange(3000), [len(s) for s in sets]), np.concatenate(sets)
    constant, weights, factors = toxicity.train(row, place, label, np.ones(3000), 12, 42, steps=1500)
    model = toxicity.Model(constant, np.arange(12), weights, factors)
    found = np.array([model.raw(s) > 0 for s in sets])
    assert (found == label).mean() > 0.99
    assert factors[0] @ factors[1] > 5 * max(abs(factors[0] @ factors[k]) for k in range(2, 12))


@pytest.mark.parametrize("rule", ["both or neither", "both", "one alone"])
def test_pairs_are_learnt_whose_halves_say_nothing(spark, docs, rule):
    """Through ``fit``: neither word tells anything alone where toxic texts hold both of them or none."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(6000):
        insult, group = rng.random(2) < 0.5
        words = [f"w{n}" for n in rng.zipf(1.3, 25) if n < 5000] + ["insult"] * int(insult) + ["group"] * int(group)
        rows.append((i, " ".join(rng.permutation(words)), "en", "s"))
        labels.append((i, int(insult == group if rule == "both or neither" else insult and group if rule == "both" else insult != group)))
    frame, marks = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.score(frame, toxicity.fit(frame, marks)).join(marks, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert ((found.score >= 0.7) == (found.toxic == 1)).mean() > 0.98


def test_toxicity_scores_are_the_machine_s(docs, spark):
    """Scores against the sum over single terms and pairs of terms, one by one."""
    from halyard.llm.terms import EDGES, bucket

    rng = np.random.default_rng(3)
    at = np.full(1 << toxicity.BITS, -1, np.int32)
    words = [f"term{i}" for i in range(60)]
    for i, w in enumerate(words[:40]):
        at[bucket(w, toxicity.BITS)] = i
    model = toxicity.Model(-0.3, at, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    texts = {i: " ".join(f"({w.upper()}," if rng.random() < 0.3 else w for w in rng.choice(words, rng.integers(0, 30))) for i in range(80)}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs([(i, t, "en", "s") for i, t in texts.items()]), model).collect()}
    for i, t in texts.items():
        places = sorted({int(at[bucket(w.strip(EDGES), toxicity.BITS)]) for w in t.lower().split()} - {-1})
        raw = model.constant + sum(model.weights[a] for a in places)
        raw += sum(float(model.factors[a] @ model.factors[b]) for n, a in enumerate(places) for b in places[n + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_quality_scores_are_the_scorer_s(docs):
    """Scores against the dot product of weights and features, one by one."""
    from collections import Counter

    rng = np.random.default_rng(4)
    weights = rng.normal(size=quality.SIZE)
    texts = {i: " ".join(rng.choice(["Ab,", "x", "x", "99%", "%%%", "Wort.", "über", "ZZ"], rng.integers(0, 40))) for i in range(60)} | {99: "a b c " * 5000}
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs([(i, t, "en", "s") for i, t in texts.items()]), quality.Model(weights, 0.5, np.zeros(0))).collect()}
    for i, t in texts.items():
        words = t.split()
        counts = Counter(b for w in words for b in quality._two(w))
        raw = sum(weights[b] * n for b, n in counts.items()) / max(1, len(words)) + weights[quality.CONSTANT]
        raw += weights[quality.REPEATED] * sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-raw)) if words else 0.0)


def test_labellers_judge_long_texts_like_short_ones():
    text = "Der Wald ist still und weit, und niemand geht hinein. " * 400
    junk = " ".join(w for n in range(600) for w in [f"wort{n % 37}"] * 8)
    assert quality.votes(junk)[3] == quality.votes(" ".join(junk.split()[:300]))[3] == quality.JUNK
    assert quality.votes(text)[3] == quality.votes(text[: len(text) // 8])[3]


def test_rare_languages_are_learnt(docs):
    rng = np.random.default_rng(5)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    text = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))
    rows = [(i, text(lang, 30), lang, "s") for i, lang in enumerate(["aa"] * 900 + ["bb"] * 300 + ["cc"] * 9)]
    model = langid.fit(docs(rows), sample=60, runs=400)
    assert model.languages == ["aa", "bb", "cc"]
    found = langid.predict(docs(rows), model).join(docs(rows).select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.98


def test_copies_count_once():
    rng = np.random.default_rng(0)
    one = np.unique(rng.integers(0, 10**6, 80))
    sets = [np.r_[one, [10**6 + i]] for i in range(10)] + [np.unique(rng.integers(0, 10**6, 80)) for _ in range(20)]
    row = np.repeat(np.arange(30), [len(s) for s in sets])
    assert toxicity.lone(row, np.concatenate(sets), 30) == pytest.approx([0.1] * 10 + [1.0] * 20)


def test_toxic_documents_are_found(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held", held_out(F.col("doc_id"))).toPandas()
    held = found[found.held]
    assert (held[held.toxic == 1].score >= 0.7).mean() > 0.7
    assert (held[held.toxic == 0].score >= 0.7).mean() < 0.03


def test_toxicity_of_odd_rows(spark, docs, odd_rows):
    frame = docs(odd_rows)
    for rows in ([], [(5, 1), (6, 0), (7, None), (None, 1), (5, 1)], [(5, 1), (6, 1)]):
        model = toxicity.fit(frame, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = toxicity.score(frame, model).collect()
        assert len(got) == len(odd_rows)
        assert all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.score(docs([]), model).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert one.constant == two.constant and np.array_equal(one.weights, two.weights)


# --- quality


def test_estimate_recovers_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.85
    accuracy, votes = [0.95, 0.8, 0.7, 0.9, 0.6], []
    for a in accuracy:
        said = np.where(rng.random(4000) < a, truth, ~truth).astype(np.uint8)
        votes.append(np.where(rng.random(4000) < 0.2, quality.NONE, said))
    share, table, good = quality.estimate(np.stack(votes, 1))
    assert share == pytest.approx(0.85, abs=0.04)
    assert table[:, quality.GOOD, quality.GOOD] == pytest.approx(accuracy, abs=0.05)
    assert ((good > 0.5) == truth).mean() > 0.95


def test_junk_is_rejected_and_clean_text_kept(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.score(docs, quality.fit(docs)).join(labels, "doc_id").toPandas()
    assert (found[found.quality == 1].quality_score >= 0.5).mean() > 0.99
    assert (found[found.quality == 0].quality_score < 0.5).mean() > 0.95


def test_quality_of_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    model = quality.fit(frame)
    got = quality.score(frame, model).collect()
    assert len(got) == len(odd_rows)
    assert {r["quality_score"] for r in got if r["doc_id"] in (1, 2, 3)} == {0.0}
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    assert {1, 2, 3}.isdisjoint({r["doc_id"] for r in kept.collect()})
    empty = docs([])
    assert quality.score(empty, quality.fit(empty)).count() == 0


# --- languages


def brute_marginals(emitted, first, model):
    """Forward-backward, one document and one word after the other."""
    out = np.empty_like(emitted)
    starts = [*np.flatnonzero(first), len(emitted)]
    step, begin = np.exp(model.transitions), np.exp(model.start)
    for lo, hi in zip(starts, starts[1:], strict=False):
        e = np.exp(emitted[lo:hi])
        alpha, beta = [begin * e[0]], [np.ones(len(begin))]
        for t in range(1, hi - lo):
            alpha.append((alpha[-1] / alpha[-1].sum() @ step) * e[t])
        for t in range(hi - lo - 1, 0, -1):
            beta.append(step @ (e[t] * beta[-1] / beta[-1].sum()))
        both = np.array(alpha) * np.array(beta[::-1])
        out[lo:hi] = both / both.sum(1, keepdims=True)
    return out


@pytest.mark.parametrize("lengths", [[1], [3, 1, 64, 65, 1, 130], [64, 64], [500], [1] * 70])
def test_marginals_match_plain_forward_backward(lengths):
    rng = np.random.default_rng(len(lengths))
    model = langid.Model(list("abc"), None, rng.normal(size=(3, 3)), rng.normal(size=3))
    first = np.zeros(sum(lengths), bool)
    first[np.cumsum(lengths) - lengths] = True
    emitted = rng.normal(size=(sum(lengths), 3))
    assert langid.marginals(emitted, first, model) == pytest.approx(brute_marginals(emitted, first, model), abs=1e-9)


def test_features_do_not_depend_on_neighbours():
    words = ["the", "über,", "--", "a", "漢字", "don't", "12"]
    together, first = langid.word_features(words)
    for i, w in enumerate(words):
        alone, _ = langid.word_features([w])
        assert sorted(together[first[i] : first[i + 1]]) == sorted(alone)
    assert first[3] == first[2] and first[7] == first[6]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98


def test_words_of_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = {r["lang"]: r["text"].split()[:40] for r in docs.where(F.length("text") > 2000).groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = spark.createDataFrame([(1, " ".join(texts["en"] + texts["de"] + texts["fr"]))], "doc_id long, text string")
    row = langid.label_words(mixed, model).first()
    want = ["en"] * 40 + ["de"] * 40 + ["fr"] * 40
    assert np.mean([a == b for a, b in zip(row["langs"], want, strict=True)]) > 0.85


def test_languages_of_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    model = langid.fit(frame)
    rows = langid.predict(frame, model).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert by_id[4]["lang_pred"] in model.languages
    assert langid.predict(docs([]), model).count() == 0
    nothing = langid.fit(docs([(1, "a", None, "s")]))
    assert langid.predict(frame, nothing).where("lang_pred <> 'und'").count() == 0
