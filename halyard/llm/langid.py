"""Language of words and documents by a linear-chain conditional random field.

Every word of a text gets a label from features of its letters: all runs of one
to three characters between its edges (so those at an edge are its affixes), and
the whole word (the learnt lexicon). Transitions between the labels of
neighbouring words are learnt too; for that, training sequences are put together
from short runs of words of documents in different languages, as in code-switched
text. Forward-backward gives each word its distribution over the languages; the
language of a document is the one with most words in expectation, its score that
share.

Forward-backward runs over a whole batch as one chain, in which the first word
of a document forgets what came before. The chain is cut into blocks of equal
length; the blocks' transfer matrices are found for all blocks at once, carried
along the blocks, and every block is then finished from its ends, so the cost
does not depend on how long single documents are and results are exact.

Defined results: a text that is null or has no letter is ``und`` with score 0;
words without letters say nothing of their own; rows with a null lang are
labelled but not learnt from; repeated rows get equal results; if nothing can be
learnt all is ``und``; of more than 256 langs the most frequent are learnt; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.terms import EDGES, held_out, sampled
from halyard.llm.workers import tidy
from halyard.session import cut

BITS = 18
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Words of one document in a row, and of a whole sequence, in training.
RUN, SEQUENCE = 12, 60
#: Words labelled at once, block length, words whose emissions a task remembers.
WORDS, BLOCK, KNOWN = 200_000, 64, 200_000
#: A word of more characters makes a task forget the words it knows, so that they never take much memory.
LONG = 1000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of some words, and where each word's begin; words without letters have none."""
    bare = ["\x02" + w.strip(EDGES) + "\x03" if LETTER.search(w) else "" for w in words]
    size = np.fromiter(map(len, bare), np.int64, len(bare))
    code = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(bare)), size)
    ids, owner = [], []
    value = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        value = value[: max(0, len(code) - n + 1)] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        ok = word[: len(value)] == word[n - 1 :] if len(value) else np.zeros(0, bool)
        inner = ok if n > 1 else ok & (code > 3)
        ids.append((value[inner] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
        owner.append(word[: len(value)][inner])
    start = np.cumsum(size) - size
    some = np.flatnonzero(size)
    if len(some):
        place = np.arange(len(code)) - np.repeat(start, size)
        mixed = (code + np.uint64(11)) * (place.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + np.uint64(0x14057B7EF767814F))
        whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), start[some])
        ids.append((whole * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
        owner.append(some)
    ids, owner = np.concatenate(ids).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """Languages, weights [bucket, language], log transitions [from, to], log start."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def emissions(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the words' feature weights [word, language], and which words have letters."""
    ids, first = word_features(words)
    out, lettered = np.zeros((len(words), weights.shape[1])), np.diff(first) > 0
    if len(ids):
        out[lettered] = np.add.reduceat(weights[ids], first[:-1][lettered], axis=0)
    return out, lettered


def marginals(emitted: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Forward-backward over documents laid end to end; ``first`` marks each one's first word."""
    n, k = emitted.shape
    rows = -(-n // BLOCK)
    e = np.ones((rows * BLOCK, k))
    e[:n] = np.exp(emitted - emitted.max(1, keepdims=True))
    new = np.ones(rows * BLOCK, bool)
    new[:n] = first
    e, new = e.reshape(rows, BLOCK, k), new.reshape(rows, BLOCK)
    step, begin = np.exp(model.transitions), np.exp(model.start)

    move = np.tile(np.eye(k), (rows, 1, 1))
    for b in range(BLOCK):
        fresh = new[:, b]
        moved = (move.reshape(-1, k) @ step).reshape(rows, k, k)
        if fresh.any():
            moved[fresh] = move[fresh].sum(2, keepdims=True) * begin
        move = moved * e[:, b, None, :]
        move /= np.maximum(move.max((1, 2), keepdims=True), 1e-300)

    enter, leave = np.empty((rows, k)), np.empty((rows, k))
    now = np.full(k, 1 / k)
    for r in range(rows):
        enter[r] = now
        now = now @ move[r]
        now = now / now.sum()
    now = np.ones(k)
    for r in range(rows - 1, -1, -1):
        leave[r] = now
        now = move[r] @ now
        now = now / now.sum()

    out = np.empty((rows, BLOCK, k))
    alpha = enter
    for b in range(BLOCK):
        alpha = np.where(new[:, b, None], begin, alpha @ step) * e[:, b]
        alpha /= np.maximum(alpha.sum(1, keepdims=True), 1e-300)
        out[:, b] = alpha
    beta = leave
    for b in range(BLOCK - 1, -1, -1):
        out[:, b] *= beta
        seen = e[:, b] * beta
        beta = np.where(new[:, b, None], 1.0, seen @ step.T)
        beta /= np.maximum(beta.sum(1, keepdims=True), 1e-300)
    out /= np.maximum(out.sum(2, keepdims=True), 1e-300)
    return out.reshape(-1, k)[:n]


def train(texts: list[tuple[int, list[str]]], languages: list[str], seed: int, epochs: int = 6, rate: float = 0.3, penalty: float = 1e-5) -> Model:
    """Maximises the likelihood of the labels of sequences put together from runs of words, by AdaGrad."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    vocabulary: dict[str, int] = {}
    runs, of = [], []
    for label, words in texts:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        for i in range(0, len(ids), RUN):
            run = ids[i : i + RUN]
            runs.append((run * RUN)[:RUN])
            of.append(label)
    runs, of = np.array(runs), np.array(of)
    ids, first = word_features(list(vocabulary))
    weights, total = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-3)
    transitions, moved = np.zeros((k, k)), np.full((k, k), 1e-3)
    start = np.zeros(k)
    per = SEQUENCE // RUN
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        order = order[: max(per, len(order) // per * per)]
        order = np.resize(order, -(-len(order) // per) * per).reshape(-1, per)
        for part in np.array_split(order, max(1, len(order) // 256)):
            word, label = runs[part].reshape(len(part), -1), np.repeat(of[part], RUN, axis=1)
            used, back = np.unique(word, return_inverse=True)
            length = first[used + 1] - first[used]
            feature = ids[np.repeat(first[used] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())]
            owner = np.repeat(np.arange(len(used)), length)
            emitted = np.zeros((len(used), k))
            some = np.flatnonzero(length)
            emitted[some] = np.add.reduceat(weights[feature], (np.cumsum(length) - length)[some], axis=0)
            score = emitted[back].reshape(*word.shape, k)
            e, step = np.exp(score - score.max(2, keepdims=True)), np.exp(transitions)
            s, t = word.shape
            alpha, beta = np.empty((t, s, k)), np.ones((t, s, k))
            for i in range(t):
                a = (np.exp(start) if i == 0 else alpha[i - 1] @ step) * e[:, i]
                alpha[i] = a / a.sum(1, keepdims=True)
            for i in range(t - 2, -1, -1):
                b = (e[:, i + 1] * beta[i + 1]) @ step.T
                beta[i] = b / b.sum(1, keepdims=True)
            both = alpha * beta
            both /= both.sum(2, keepdims=True)
            error = both.transpose(1, 0, 2) - np.eye(k)[label]
            by_word = np.stack([np.bincount(back.ravel(), error[:, :, c].ravel(), len(used)) for c in range(k)], 1) / s
            touched, where = np.unique(feature, return_inverse=True)
            slope = np.stack([np.bincount(where, by_word[owner, c], len(touched)) for c in range(k)], 1) + penalty * weights[touched]
            total[touched] += slope**2
            weights[touched] -= rate * slope / np.sqrt(total[touched])
            pairs = alpha[:-1, :, :, None] * step * (e.transpose(1, 0, 2)[1:] * beta[1:])[:, :, None, :]
            pairs /= pairs.sum((2, 3), keepdims=True)
            seen = np.zeros((k, k))
            np.add.at(seen, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
            slope = (pairs.sum((0, 1)) - seen) / s + 1e-3 * transitions
            moved += slope**2
            transitions -= rate * slope / np.sqrt(moved)
    return Model(languages, weights.astype(np.float32), transitions, start)


def fit(docs: DataFrame, sample: int = 4000, runs: int = 80_000, languages: int = 256, seed: int = 42) -> Model:
    """Fits on runs of words of a bounded sample of documents that are not held out and have a lang.

    Every lang, the ``languages`` most frequent ones if there are more, gives an equal
    part of about ``sample`` documents, or all it has; of all runs of their whole texts
    about ``runs`` take part.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    rates = [(r["lang"], sample / len(counts) / r["count"]) for r in counts]
    steps = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(steps))
    rate = docs.sparkSession.createDataFrame(rates, "_lang string, _rate double")
    chosen = known.join(F.broadcast(rate), (F.col("lang") == F.col("_lang")) & (draw < steps * F.col("_rate"))).where(F.col("text").isNotNull())
    chosen = cut(chosen.select("doc_id", "lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words = [w for w in text.as_py().lower().split() if LETTER.search(w)]
                found = [" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]
                for lo in range(0, len(found), 1 << 14):
                    some = found[lo : lo + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(x, len(some)) for x in (doc_id, lang)] + [pa.array(range(lo, lo + len(some)), pa.int64()), pa.array(some, pa.string())], ["doc_id", "lang", "place", "run"])

    every = chosen.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, place long, run string")
    rows = sampled(every, F.struct("doc_id", "place"), runs, seed).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["lang"], r["place"], r["run"]))
    names = sorted({r["lang"] for r in rows})
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(names)}
    return train([(number[r["lang"]], r["run"].split()) for r in rows], names, seed)


class _Known:
    """Emissions of the words that a task has met lately, and whether they have letters."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.emitted, self.lettered = np.empty((0, len(self.model.languages))), np.empty(0, bool)

    def ids(self, texts: list[list[str]]) -> np.ndarray:
        """Places of all words, one text after the other."""
        fresh = set().union(*texts).difference(self.place)
        if fresh:
            if len(self.place) + len(fresh) > KNOWN or any(len(w) > LONG for w in fresh):
                self.forget()
                fresh = set().union(*texts)
            words = list(fresh)
            self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
            emitted, lettered = emissions(words, self.model.weights)
            self.emitted, self.lettered = np.concatenate([self.emitted, emitted]), np.concatenate([self.lettered, lettered])
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))


def _labelled(texts: list[str | None], known: _Known) -> Iterator[tuple[list[int], list[list[str]], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts with letters, some at a time: places, words, first word of each text, the words' distributions, which have letters."""

    def finish(places: list[int], words: list[list[str]]) -> tuple:
        count = np.array([len(w) for w in words])
        ids, start = known.ids(words), np.cumsum(count) - count
        first = np.zeros(len(ids), bool)
        first[start] = True
        return places, words, start, marginals(known.emitted[ids], first, known.model), known.lettered[ids]

    places, words, held = [], [], 0
    for i, text in enumerate(texts):
        if text and LETTER.search(text) and known.model.languages:
            places.append(i)
            words.append(text.lower().split())
            held += len(words[-1])
            if held >= WORDS:
                yield finish(places, words)
                places, words, held = [], [], 0
    if places:
        yield finish(places, words)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = _Known(own)
        for batch in batches:
            lang, share = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for places, _, start, found, lettered in _labelled(batch.column(1).to_pylist(), known):
                total = np.add.reduceat(found * lettered[:, None], start, axis=0)
                share[places] = total.max(1) / total.sum(1)
                for i, best in zip(places, total.argmax(1).tolist(), strict=True):
                    lang[i] = own.languages[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, words and langs (the likeliest label of each word) of every text with letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = _Known(own)
        for batch in batches:
            for places, words, start, found, _ in _labelled(batch.column(1).to_pylist(), known):
                best = np.array(own.languages, object)[found.argmax(1)]
                langs = [part.tolist() for part in np.split(best, start[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(words), pa.array(langs)], ["doc_id", "words", "langs"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words array<string>, langs array<string>")
