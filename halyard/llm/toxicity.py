"""Toxicity by a factorization machine over hashed terms.

A text is the set of buckets of its terms (lower-cased words without punctuation
at their ends). Its raw score is a constant, a weight for every bucket, and for
every pair of buckets the inner product of their factors, so that a pair such as
insult and group mention can count for more than its parts (Rendle, 2010). The
model is fitted to a bounded sample of labelled documents, on the buckets that say
something of the label by more than chance: alone, or in a pair with another one (among
the ``PAIRED`` most frequent buckets), be either of them neutral by itself.

Defined results: null and empty texts are scored by the constant alone; repeated
rows get equal scores; documents without a label, or with a null one, are scored
but not learnt from; an empty table gives an empty result; without labels of both
classes the score is the smoothed share of toxic labels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.graph import local_roots
from halyard.llm.terms import EDGES, Memo, bucket, held_out, sampled
from halyard.llm.workers import tidy

BITS = 20
FACTORS = 4
#: Buckets, the most frequent ones, of which all pairs are looked at; rows counted at once.
PAIRED, ROWS = 1024, 4096


def _bucket(word: str) -> int:
    term = word.strip(EDGES)
    return bucket(term, BITS) if term else -1


@dataclass
class Model:
    """``at`` is the place of a bucket in ``weights`` and ``factors``, or -1."""

    constant: float
    at: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, buckets: np.ndarray) -> float:
        """The raw score of a set of places."""
        v = self.factors[buckets]
        return self.constant + self.weights[buckets].sum() + 0.5 * float(np.square(v.sum(0)).sum() - np.square(v).sum())


def lone(row: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """1 / the number of near copies of each row, itself included, so that copies count as one.

    Rows are near copies if they agree in the three least hashes of one of five bands;
    buckets that more than a tenth of the rows have take no part.
    """
    count = np.bincount(buckets, minlength=1)
    rare = count[buckets] <= max(50, n // 10)
    row, buckets = row[rare], buckets[rare].astype(np.uint64)
    if not len(row):
        return np.ones(n)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = []
    for i in range(15):
        mixed = (buckets + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least.append(np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), first))
    ones, others = [], []
    for i in range(0, 15, 3):
        band = np.stack(least[i : i + 3])
        order = np.lexsort(band)
        same = (band[:, order][:, 1:] == band[:, order][:, :-1]).all(0)
        ones.append(row[first][order][:-1][same])
        others.append(row[first][order][1:][same])
    one, other = np.concatenate(ones), np.concatenate(others)
    weight = np.ones(n)
    if len(one):
        nodes, roots = local_roots(one, other)
        _, back, size = np.unique(roots, return_inverse=True, return_counts=True)
        weight[nodes] = 1 / size[back]
    return weight


def telling(count: np.ndarray, toxic: np.ndarray, n: float, positive: float) -> np.ndarray:
    """Buckets whose share of toxic documents is no chance.

    ``count`` and ``toxic`` are the documents and the toxic ones of each bucket.
    By Chernoff's bound a share as far from the overall one has at most the
    probability exp(-count * divergence); buckets stay if less than one such
    bucket is to be expected among all.
    """
    share, base = toxic / np.maximum(1, count), positive / n
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    return np.flatnonzero((count > 1) & (count * part >= np.log(max(2, (count > 1).sum()))))


def _gain(n: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """By how many nats the toxic ones of n documents depart from a share that they should have."""
    found, share = np.clip(toxic / np.maximum(n, 1e-9), 0, 1), np.clip(share, 1e-6, 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(found > 0, found * np.log(found / share), 0) + np.where(found < 1, (1 - found) * np.log((1 - found) / (1 - share)), 0)
    return n * part


def telling_pairs(row: np.ndarray, buckets: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Buckets of pairs that tell more than each of their halves does.

    Documents that hold both buckets must depart from the share that those holding one
    have, and from the share that those holding the other have, by more than chance
    among all pairs looked at (Chernoff's bound again).
    """
    count = np.bincount(buckets, weight[row], 1 << BITS)
    top = np.sort(np.argsort(-count, kind="stable")[: min(PAIRED, int((count > 1).sum()))])
    at = np.full(1 << BITS, -1, np.int32)
    at[top] = np.arange(len(top))
    known = at[buckets] >= 0
    row, place = row[known], at[buckets[known]]
    both, toxic = np.zeros((len(top), len(top)), np.float32), np.zeros((len(top), len(top)), np.float32)
    for lo in range(0, len(label), ROWS):
        some = slice(*np.searchsorted(row, [lo, lo + ROWS]))
        held = np.zeros((min(ROWS, len(label) - lo), len(top)), np.float32)
        held[row[some] - lo, place[some]] = 1
        mass = weight[lo : lo + ROWS].astype(np.float32)
        both += held.T @ (held * mass[:, None])
        bad = label[lo : lo + ROWS] == 1
        toxic += held[bad].T @ (held[bad] * mass[bad, None])
    n, share = np.diag(both), np.diag(toxic) / np.maximum(np.diag(both), 1e-9)
    chance = np.log(max(2, len(top) * (len(top) - 1)))
    found = np.minimum(_gain(both, toxic, share[:, None]), _gain(both, toxic, share[None, :])) >= chance
    found &= ~np.eye(len(top), dtype=bool) & (both < np.minimum(n[:, None], n[None, :]))
    return top[found.any(0)]


def train(row: np.ndarray, place: np.ndarray, label: np.ndarray, weight: np.ndarray, width: int, seed: int, steps: int = 300, ridge: float = 1e-5, rate: float = 0.05) -> tuple[float, np.ndarray, np.ndarray]:
    """Constant, weights and factors by Adam over all weighted rows; ``row`` and ``place`` are the rows' buckets.

    Weights begin at, and are drawn towards, the log-odds of their bucket, so that a
    telling term counts in full where it stands alone, though it rarely does in training.
    """
    rng = np.random.default_rng(seed)
    n, mass = len(label), weight.sum()
    base = float(np.log((weight @ label) / (weight @ (1 - label))))
    count, toxic = np.bincount(place, weight[row], width), np.bincount(place, (weight * label)[row], width)
    odds = np.log((toxic + 0.5) / (count - toxic + 0.5)) - base
    found = np.concatenate([[base], odds, rng.normal(0, 0.05, width * FACTORS)])
    home = np.concatenate([[base], odds, np.zeros(width * FACTORS)])
    first, second = np.zeros_like(found), np.zeros_like(found)
    penalty = np.full(len(found), ridge)
    penalty[0] = 100 * ridge
    penalty[1 + width :] *= 10
    for step in range(1, steps + 1):
        weights, v = found[1 : 1 + width], found[1 + width :].reshape(width, FACTORS)[place]
        total = np.stack([np.bincount(row, v[:, f], n) for f in range(FACTORS)], 1)
        square = np.bincount(row, np.square(v).sum(1), n)
        raw = found[0] + np.bincount(row, weights[place], n) + 0.5 * (np.square(total).sum(1) - square)
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * weight / mass
        pull = error[row][:, None] * (total[row] - v)
        by_factor = np.stack([np.bincount(place, pull[:, f], width) for f in range(FACTORS)], 1)
        slope = np.concatenate([[error.sum()], np.bincount(place, error[row], width), by_factor.ravel()]) + penalty * (found - home)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        found = found - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return float(found[0]), found[1 : 1 + width], found[1 + width :].reshape(width, FACTORS)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 42) -> Model:
    """Fits on about ``sample`` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sampled(known, F.col("doc_id"), sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_bucket)
        for batch in batches:
            found = [np.unique(np.fromiter(map(memo.__getitem__, (t or "").lower().split()), np.int32)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "buckets"])

    # the sample is bounded, so is what is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = rows.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, buckets binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    label = np.array([min(1, max(0, r["toxic"])) for r in rows])
    share = (label.sum() + 1) / (len(label) + 2)
    nothing = Model(float(np.log(share / (1 - share))), np.full(1 << BITS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < label.sum() < len(label):
        return nothing
    sets = [np.frombuffer(r["buckets"], np.int32) for r in rows]
    buckets = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, buckets = row[buckets >= 0], buckets[buckets >= 0]
    weight = lone(row, buckets, len(label))
    alone = telling(np.bincount(buckets, weight[row], 1 << BITS), np.bincount(buckets, (weight * label)[row], 1 << BITS), weight.sum(), weight @ label)
    used = np.union1d(alone, telling_pairs(row, buckets, label, weight))
    if not len(used):
        return nothing
    at = np.full(1 << BITS, -1, np.int32)
    at[used] = np.arange(len(used))
    known = at[buckets] >= 0
    constant, weights, factors = train(row[known], at[buckets[known]], label, weight, len(used), seed)
    return Model(constant, at, weights, factors)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from 0 to 1, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value

        def place(word: str) -> int:
            found = _bucket(word)
            return int(own.at[found]) if found >= 0 else -1

        memo = Memo(place)
        for batch in batches:
            raw = []
            for text in batch.column(1):
                places = set(map(memo.__getitem__, (text.as_py() or "").lower().split()))
                places.discard(-1)
                raw.append(own.raw(np.array(sorted(places), np.int64)))
            found = 1 / (1 + np.exp(-np.clip(np.array(raw, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
