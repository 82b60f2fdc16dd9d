"""Quality classifier from weak labels.

Heuristic labellers vote on a text: good, junk, or nothing. Expectation
maximisation over a bounded sample estimates how often each labeller gives each
vote on good and on junk texts (Dawid and Skene, 1979); the posterior of good,
given all votes, is the label that trains a logistic scorer over hashed terms.
The scorer alone then rates every whole text. No gold label takes part.

Terms are words, word shapes, and a mark for a word that repeats the one before;
their values are relative frequencies, so long texts are rated like short ones.

Defined results: null and empty texts, and texts of white space, score 0 and are
rejected; repeated rows get equal scores; an empty table gives an empty result
(a model that rates everything 0.5 is fitted); ``sample`` bounds the rows that
the fit reads; other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log2
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.terms import EDGES, Memo, bucket, sampled
from halyard.llm.workers import tidy

BITS = 16
#: Buckets after the hashed ones: a repeated word, and the constant.
REPEATED, CONSTANT = 1 << BITS, (1 << BITS) + 1
SIZE = (1 << BITS) + 2
GOOD, JUNK, NONE = 1, 0, 2


def _shape(word: str) -> str:
    """Runs of letters, digits and each other character, collapsed: ``en%%%`` -> ``a%``."""
    if word.isalpha() and (kind := "a" if word.islower() else "A" if word.isupper() else "Aa" if word.istitle() else ""):
        return kind
    if word[-1] in ".," and word[:-1].isalpha():
        return _shape(word[:-1]) + word[-1]
    out: list[str] = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def votes(text: str | None) -> list[int]:
    """What each labeller says about a text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [NONE] * LABELLERS
    share = lambda low, high, x: GOOD if x <= low else JUNK if x >= high else NONE
    letters = [c for w in words for c in w if not c.isalnum() and c not in PUNCTUATION]
    marks = len(letters) / n
    repeats = sum(map(eq, words, words[1:])) / max(1, n - 1)
    alone = sum(1 for w in words if not any(map(str.isalnum, w))) / n
    counts = Counter(words)
    ended = sum(1 for w in words if w[-1] in ".!?") / n
    pure = sum(1 for w in words if w.strip(PUNCTUATION).isalpha()) / n
    loud = sum(1 for w in words if len(w) > 1 and w.isupper()) / n
    doubled = sum(1 for w in words if len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum()) / n
    entropy = -sum(c / n * log2(c / n) for c in counts.values()) / max(1.0, log2(n))
    length = sum(map(len, words)) / n
    variety = sum(len(set(words[i : i + SPAN])) for i in range(0, n, SPAN)) / n
    enough = n >= 20
    return [
        share(0.05, 0.25, marks),
        share(0.05, 0.25, repeats) if n > 4 else NONE,
        share(0.02, 0.15, alone),
        (JUNK if variety < 0.2 else GOOD if variety > 0.45 else NONE) if enough else NONE,
        (GOOD if 0.01 <= ended <= 0.4 else JUNK) if enough else NONE,
        GOOD if pure > 0.9 else JUNK if pure < 0.6 else NONE,
        (GOOD if entropy > 0.75 else JUNK if entropy < 0.55 else NONE) if enough else NONE,
        GOOD if 2 <= length <= 14 else JUNK,
        share(0.2, 0.6, loud),
        share(0.03, 0.25, doubled),
    ]


#: Punctuation of ordinary prose.
PUNCTUATION = ".,;:!?'\"()-"
LABELLERS = 10
#: Words among which different ones are counted, so that long texts are judged like short ones.
SPAN = 200


def estimate(given: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """EM: share of good texts, votes' probabilities [labeller, class, vote], posterior of good.

    A labeller that says nothing of a text gives no evidence on it.
    A few imagined votes hold each labeller to be right more often than wrong,
    so classes keep their meaning where votes are few or all alike.
    """
    n, m = given.shape
    hot = np.eye(3)[given][:, :, :NONE]
    prior = np.zeros((m, 2, 2))
    prior[:, JUNK] = (6, 1)
    prior[:, GOOD] = (1, 6)
    good = np.clip((given == GOOD).sum(1) + 1.0, 1, None)
    good /= good + (given == JUNK).sum(1) * 1.0 + 1
    share, table = 0.8, prior / prior.sum(2, keepdims=True)
    for _ in range(rounds):
        share = (good.sum() + 8) / (n + 10)
        weight = np.stack([1 - good, good], 1)
        table = np.einsum("nc,nlv->lcv", weight, hot) + prior
        table /= table.sum(2, keepdims=True)
        lean = np.log(share / (1 - share)) + np.einsum("nlv,lv->n", hot, np.log(table[:, GOOD]) - np.log(table[:, JUNK]))
        new = 1 / (1 + np.exp(-np.clip(lean, -30, 30)))
        if np.abs(new - good).max(initial=0) < 1e-6:
            break
        good = new
    return float(share), table, good


@dataclass
class Model:
    """Weights over buckets, and what EM found out about the labellers."""

    weights: np.ndarray
    share: float
    accuracies: np.ndarray


def _features(text: str, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and relative frequencies of a text with words."""
    words = text.split()
    ids = np.array([memo[w] for w in words]).ravel()
    found, count = np.unique(ids, return_counts=True)
    repeats = sum(map(eq, words, words[1:])) / len(words)
    return np.r_[found, REPEATED, CONSTANT], np.r_[count / len(words), repeats, 1.0].astype(np.float32)


def _two(word: str) -> tuple[int, int]:
    return bucket("w " + word.lower().strip(EDGES), BITS), bucket("s " + _shape(word), BITS)


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam over the whole sample."""
    weights, first, second = (np.zeros(SIZE) for _ in range(3))
    for step in range(1, steps + 1):
        raw = np.bincount(row, value * weights[column], len(target))
        error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target
        slope = np.bincount(column, value * error[row], SIZE) / len(target) + penalty * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def fit(docs: DataFrame, sample: int = 6000, seed: int = 42) -> Model:
    """Fits on about ``sample`` documents at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_two)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t and not t.isspace()]
            rows = [(bytes(votes(t)), *(x.tobytes() for x in _features(t, memo))) for t in texts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["votes", "buckets", "values"])

    chosen = sampled(docs.select("doc_id", "text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), sample, seed)
    rows = chosen.select("text").mapInArrow(tidy(run), "votes binary, buckets binary, values binary").collect()
    if not rows:
        return Model(np.zeros(SIZE), 0.5, np.full(LABELLERS, 0.5))
    rows.sort(key=lambda r: (bytes(r["buckets"]), bytes(r["values"])))
    share, table, good = estimate(np.frombuffer(b"".join(r["votes"] for r in rows), np.uint8).reshape(len(rows), -1))
    column = [np.frombuffer(r["buckets"], np.int64) for r in rows]
    value = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(c) for c in column])
    return Model(_logistic(row, np.concatenate(column), value, good), share, share * table[:, GOOD, GOOD] + (1 - share) * table[:, JUNK, JUNK])


def rating(docs: DataFrame, model: Model) -> Column:
    """quality_score of ``docs``' text, from 0 to 1; only the text goes to Python."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(run)(batches)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = weights.value.tolist()

        def weight(word: str) -> float:
            one, two = _two(word)
            return own[one] + own[two]

        memo = Memo(weight)
        for batch in batches:
            found = []
            for text in batch:
                words = (text.as_py() or "").split()
                if not words:
                    found.append(0.0)
                    continue
                raw = sum(map(memo.__getitem__, words)) + own[REPEATED] * sum(map(eq, words, words[1:]))
                found.append(1 / (1 + exp(-min(30.0, max(-30.0, raw / len(words) + own[CONSTANT])))))
            yield pa.array(found, pa.float64())

    return rate(F.col("text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and quality_score of every whole text."""
    return docs.select("doc_id", rating(docs, model).alias("quality_score"))


def keep_good(docs: DataFrame, threshold: float = 0.5, sample: int = 6000, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    return docs.where(rating(docs, fit(docs, sample, seed)) >= threshold)
