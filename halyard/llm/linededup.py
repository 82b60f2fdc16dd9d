"""Near-duplicate lines by a segment-partition edit join.

Two different lines link if one turns into the other by few edits of characters: one
for every ``per_edit`` characters of the shorter line, ``max_edits`` at most. If
``per_word`` is given, lines of that many words or more are sequences of words
instead: an edit inserts, removes or replaces a word, and the line with fewer words
may have one for every ``per_word`` of them, however long it is; only if it has fewer
than ``per_word`` words are both sequences of characters.

The shorter line is partitioned into one segment more than it may have edits, so at
least one segment survives in the longer line. Of few characters, a segment is filed
whole, and the longer line probes with the substrings that its length leaves possible
(multi-match-aware selection). Of words, a segment is filed under its substring of
``GRAM`` words with the least hash, and the longer line probes with its substrings
that are least in any stretch as long as a segment of a line that it may link to, so
their number grows with the line, not with the edits. Substrings that are frequent in
a bounded sample count as greater than others, which decides what is quick but never
what is found. What meets at a key is filtered by length and place (of words), by the
parity of characters, of which an edit flips two at most, and by a sketch: the parity of
pairs of characters, of which an edit flips four at most, or of words, two at most. It
is then verified exactly by a banded bit-parallel edit distance.

Equal lines are one line, which takes part once, so a line that a third of all
documents hold costs no more than another. Keys travel in buckets, packed by the task
that makes them, and a bucket is sorted in memory where it arrives; a bucket of more
than ``MOST`` keys is dealt again key by key, and a key with more than ``CROWD`` pairs
is split into parts, each compared in a task of its own. What a task verifies goes on
as counts and a forest. A class of lines is a component over the links; its first
member, by doc_id and line number, is the one that ``deduplicate`` keeps.

Defined results: lines end at \\n; lines of white space alone are no lines here
and always stay; a null text has no lines and stays null; lines too short for an
edit link only to equal lines; ids of any type that can be ordered; repeated rows
(one doc_id) are one document, whose lines at one place are told apart by their text
and are all kept if their class begins there; lines of rows without doc_id come
after all others and stay if no other line of their class has an id; an empty
table gives an empty result; other columns are ignored by ``classes`` and kept by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from halyard.llm.graph import components, local_roots
from halyard.llm.terms import sampled
from halyard.llm.workers import tidy
from halyard.session import cut

#: Pairs at one key beyond which the key is split.
CROWD = 1 << 26
#: Rows of a part of a split key; rows of a bucket, or of a key, that are held in memory at most.
PART, MOST = 1 << 12, 1 << 22
#: Bytes of text for every bucket (some 250,000 keys), and buckets for every shuffle partition at least.
BUCKET, BUCKETS = 1 << 22, 8
#: Documents that tell which substrings are frequent, lines of them that hold a frequent one, and most substrings told.
SAMPLE, FREQUENT, TOLD = 8000, 4, 1 << 16
#: Pairs compared at once, characters hashed at once, lines that a task remembers having sent.
PAIRS, CHARS, SEEN = 1 << 19, 1 << 19, 1 << 17
#: Ids of lines to verify that are broadcast at most; beyond that they are joined by shuffle.
BROADCAST_IDS = 1 << 19
#: Widest band that fits into 64 bits, and pairs that are compared at once at least.
LANE, FEW = 31, 12
#: Words of a substring under which a segment of words is filed.
GRAM = 4
#: A key is a hash, and from its end: payload, whether it is of words, whether it probes.
WORDS, PROBES, HASH = 1 << 20, 1 << 21, 22
#: Places of words in a line that a key tells apart, and how far a run of equal substrings is followed until one probes again.
FAR, RUN = (1 << 12) - 1, 8

BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
SPACE = np.array([chr(c).isspace() for c in range(0x3001)])


@dataclass(frozen=True)
class Rule:
    """How many edits lines may have."""

    max_edits: int = 2
    per_edit: int = 16
    per_word: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.max_edits < 64 or self.per_edit < 8 or (self.per_word is not None and self.per_word < 2 * GRAM):
            raise ValueError(f"max_edits must be from 0 to 63, per_edit 8 or more, per_word none or {2 * GRAM} or more")

    @property
    def shortest(self) -> int:
        """Characters of the shortest line that may have an edit."""
        return self.per_edit if self.per_word is None else min(self.per_edit, 2 * self.per_word - 1)

    def chars(self, length: np.ndarray | int) -> np.ndarray | int:
        """Edits of characters that a line of so many may have."""
        return np.minimum(self.max_edits, np.asarray(length) // self.per_edit)

    def stretch(self, words: int) -> int:
        """Substrings of GRAM words that every segment has, of lines that one of so many words may probe for."""
        least = range(max(self.per_word, words - words // self.per_word), words + 1)
        return min(n // (n // self.per_word + 1) for n in least) - GRAM + 1

    @property
    def ratio(self) -> float:
        """Of the lengths of two classes; less than 256 of them hold all lines."""
        return max(1.09, 1.01 * self.per_word / (self.per_word - 1))

    def size(self, words: np.ndarray | int) -> np.ndarray:
        """A class of lengths; those of lines that link differ by one at most."""
        return np.floor(np.log(words) / np.log(self.ratio)).astype(np.int64)

    def reach(self, size: np.ndarray) -> np.ndarray:
        """Words by which places may differ, of lines of a class of lengths."""
        return np.floor(self.ratio ** (size + 1) / self.per_word).astype(np.int64) + RUN


def linked(lines: list[str], one: np.ndarray, two: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether pairs of lines, given by their numbers, link."""
    split = [line.split() for line in lines] if rule.per_word is not None else []
    number = {word: i for i, word in enumerate(set().union(*split))}
    count = np.array([len(w) for w in split])
    of_words = np.minimum(count[one], count[two]) >= rule.per_word if rule.per_word is not None else np.zeros(len(one), bool)
    ids = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in split]
    out = np.zeros(len(one), bool)
    if of_words.any():
        limit = np.minimum(count[one], count[two]) // rule.per_word
        out[of_words] = within(ids, one[of_words], two[of_words], limit[of_words])
    if not of_words.all():
        codes = [np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.int32) for line in lines]
        length = np.array([len(x) for x in codes])
        limit = rule.chars(np.minimum(length[one], length[two]))
        out[~of_words] = within(codes, one[~of_words], two[~of_words], limit[~of_words])
    return out


def within(sequences: list[np.ndarray], one: np.ndarray, two: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether pairs of sequences, given by their numbers, are at most ``limit`` edits apart; many pairs at once."""
    length = np.array([len(x) for x in sequences])
    short, long = np.where(length[one] <= length[two], one, two), np.where(length[one] <= length[two], two, one)
    found = length[long] - length[short] <= limit
    todo = np.flatnonzero(found & (short != long))
    # lanes hold pairs of like bands and lengths; where few are alike, one after the other is quicker
    wide, steps = np.minimum(limit[todo], LANE), np.int64(2 * np.log2(length[long[todo]] + 1))
    order = np.lexsort((steps, wide))
    todo, alike = todo[order], np.stack([wide, steps])[:, order]
    cuts = np.flatnonzero(np.r_[True, (alike[:, 1:] != alike[:, :-1]).any(0)]) if len(todo) else []
    far = []
    for begin, end in zip(cuts, [*cuts[1:], len(todo)], strict=True):
        for lo in range(begin, end, 1 << 10):
            some = todo[lo : min(end, lo + (1 << 10))]
            if len(some) < FEW:
                far.append(some)
                continue
            score = _banded_lanes([sequences[i] for i in short[some].tolist()], [sequences[i] for i in long[some].tolist()], int(alike[0, begin]))
            found[some] = score <= limit[some]
            far.append(some[(score > LANE) & (limit[some] > LANE)])
    for i in np.concatenate(far).tolist() if far else []:
        x, y = sequences[short[i]], sequences[long[i]]
        # an edit takes one away and adds one, at most
        values, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        more = np.bincount(at[: len(x)], minlength=len(values)) - np.bincount(at[len(x) :], minlength=len(values))
        found[i] = max(more[more > 0].sum(), -more[more < 0].sum()) <= limit[i] and edit_distance(x, y, int(limit[i])) <= limit[i]
    return found


def _banded_lanes(xs: list[np.ndarray], ys: list[np.ndarray], limit: int) -> np.ndarray:
    """``_banded`` of pairs whose first is not the longer one, a number of 64 bits each; ``limit`` is LANE at most."""
    m, n = (np.array([len(s) for s in side]) for side in (xs, ys))
    width = 2 * limit + 1
    x, y = np.full((len(xs), max(int(m.max()), int(n.max())) + width), -1, np.int32), np.full((len(ys), int(n.max())), -2, np.int32)
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[i, limit : limit + len(a)] = a
        y[i, : len(b)] = b
    one = np.uint64(1)
    full, top = np.uint64((1 << width) - 1), np.uint64(2 * limit)
    up, down = np.full(len(xs), full ^ np.uint64((1 << limit) - 1)), np.zeros(len(xs), np.uint64)
    score = np.minimum(limit, m)
    bits = np.zeros((len(xs), 8), np.uint8)
    for j in range(1, y.shape[1] + 1):
        packed = np.packbits(x[:, j - 1 : j - 1 + width] == y[:, j - 1, None], axis=1, bitorder="little")
        bits[:, : packed.shape[1]] = packed
        match = bits.view(np.uint64).ravel()
        kept = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(kept | up)) & full, kept & up
        row = np.clip(m - j + limit, 0, 63).astype(np.uint64)
        along = (right >> row & one).astype(np.int64) - (left >> row & one).astype(np.int64)
        score = score + np.where(j > n, 0, np.where(j + limit <= m, 1 - (kept >> top & one).astype(np.int64), along))
        down = (kept >> one) & right
        up = (left | ~((kept >> one) | right)) & full
    return np.minimum(score, limit + 1)


def edit_distance(one: np.ndarray, two: np.ndarray, limit: int) -> int:
    """Edit distance of two sequences, or ``limit + 1`` if it is more; narrow bands are tried first."""
    x, y = (one, two) if len(one) <= len(two) else (two, one)
    if len(y) - len(x) > limit:
        return limit + 1
    same = x == y[: len(x)]
    head = len(x) if same.all() else int(same.argmin())
    x, y = x[head:], y[head:]
    if len(x):
        same = x[::-1] == y[::-1][: len(x)]
        tail = len(x) if same.all() else int(same.argmin())
        x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not limit:
        return min(len(y), limit + 1)
    band = max(4, len(y) - len(x))
    while band < limit:
        found = _banded(x, y, band)
        if found <= band:
            return found
        band *= 8
    return _banded(x, y, limit)


def _banded(x: np.ndarray, y: np.ndarray, limit: int) -> int:
    """Bit-parallel edit distance within a band; ``limit + 1`` if it is more."""
    m, width = len(x), 2 * limit + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        places[c] = places.get(c, 0) | 1 << i
    # In column j bit r stands for row j - limit + r. The score goes down the
    # lowest diagonal of the band as far as the last row, then along that row.
    up, down, score = full ^ ((1 << limit) - 1), 0, min(limit, m)
    for j, c in enumerate(y.tolist(), 1):
        shift = j - limit - 1
        match = places.get(c, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        kept = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(kept | up)) & full, kept & up
        if j + limit <= m:
            score += 1 - (kept >> 2 * limit & 1)
        else:
            row = m - j + limit
            score += (right >> row & 1) - (left >> row & 1)
        down = (kept >> 1) & right
        up = (left | ~((kept >> 1) | right)) & full
    return min(score, limit + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2 ** 64."""
    have = _powers.__dict__.get("have")
    if have is None or len(have[0]) < n:
        steps = np.full((2, max(n, 2 * CHARS)), (BASE,), np.uint64)
        steps[1] = BACK
        steps[:, 0] = 1
        have = _powers.__dict__["have"] = tuple(np.cumprod(steps, axis=1))
    return have[0][:n], have[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of lines laid end to end, with an end of line between; length and start of each line; sums and powers that hash any part."""
    code = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    power, inverse = _powers(len(code) + 1)
    total = np.r_[np.uint64(0), np.cumsum((code + np.uint64(7)) * power[: len(code)])]
    return code, length, np.cumsum(length + 1) - length - 1, total, inverse


def _key(value: np.ndarray, probe: bool, payload: np.ndarray) -> np.ndarray:
    return (_mixed(value) >> np.uint64(HASH) << np.uint64(HASH)) | np.uint64(PROBES * probe) | payload.astype(np.uint64)


Keys = tuple[np.ndarray, np.ndarray, np.ndarray]


def keys_of_characters(lines: list[str], rule: Rule) -> Keys:
    """Line and key of the segments of lines, and of the substrings that they probe with; and each line's sketch."""
    code, length, start, total, inverse = _codes(lines)
    pair = np.uint64(1) << (_mixed(code[:-1] * np.uint64(0x1F123BB5) + code[1:]) >> np.uint64(58))
    pair[start[1:] - 1] = 0
    pair[start[1:] - 2] = 0
    sketch = np.bitwise_xor.reduceat(pair, start)
    own = np.uint64(1) << (_mixed(code) % np.uint64(20))
    own[start[1:] - 1] = 0
    parity = np.bitwise_xor.reduceat(own, start)
    found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]

    def add(line: np.ndarray, at: np.ndarray, size: np.ndarray, of: np.ndarray, segment: int, probe: bool) -> None:
        a = start[line] + at
        value = (total[a + size] - total[a]) * inverse[a]
        found.append((line, _key(value + _mixed((of * 64 + segment).astype(np.uint64)), probe, parity[line])))

    for longer in range(rule.max_edits + 1):
        of = length - longer
        edits = rule.chars(of)
        for t in range(max(1, longer), rule.max_edits + 1):
            line = np.flatnonzero(edits == t)
            base = of[line] // (t + 1)
            wide = of[line] - base * (t + 1)
            for i in range(t + 1):
                grown = np.maximum(0, i - (t + 1 - wide))
                p, size = i * base + grown, base + (i >= t + 1 - wide)
                if not longer:
                    add(line, p, size, of[line], i, False)
                low = np.maximum(0, np.maximum(p - i, p + longer - (t - i)))
                high = np.minimum(length[line] - size, np.minimum(p + i, p + longer + (t - i)))
                for off in range(-t, t + longer + 1):
                    at = p + off
                    ok = (at >= low) & (at <= high)
                    if ok.any():
                        add(line[ok], at[ok], size[ok], of[line][ok], i, True)
    line, key = (np.concatenate(x) for x in zip(*found, strict=True))
    return line, key, sketch


@dataclass
class Grams:
    """Substrings of GRAM words of lines laid end to end: hash of each, which of them end in their line, place there; first word and number of words of each line; hash of each word."""

    hash: np.ndarray
    inside: np.ndarray
    place: np.ndarray
    first: np.ndarray
    count: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, lines: list[str]) -> Grams:
        code, _, start, total, inverse = _codes(lines)
        blank = SPACE[np.minimum(code, 0x3000)] & (code <= 0x3000)
        begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
        first = np.searchsorted(begin, start)
        count = np.diff(np.r_[first, len(begin)])
        word = _mixed((total[end] - total[begin]) * inverse[begin])
        gram = np.zeros(max(0, len(word) - GRAM + 1), np.uint64)
        for i in range(GRAM):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + word[i : len(gram) + i]
        place = (np.arange(len(word)) - np.repeat(first, count))[: len(gram)]
        return cls(_mixed(gram), place + GRAM <= np.repeat(count, count)[: len(gram)], place, first, count, word)


def keys_of_words(lines: list[str], rule: Rule, frequent: np.ndarray, level: np.ndarray) -> Keys:
    """Line and key of the segments of lines of ``per_word`` words or more, and of the substrings that they probe with; and each line's sketch. Lines of one stretch lie together."""
    found = Grams.of(lines)
    first, count, place = found.first, found.count, found.place
    # in the order that decides: level, hash, place; substrings that run into the next line come last
    gram = found.hash >> np.uint64(4)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found.hash), len(frequent) - 1)
        gram |= np.where(frequent[at] == found.hash, level[at], 0).astype(np.uint64) << np.uint64(60)
    gram = gram & ~np.uint64(FAR) | np.minimum(place, FAR).astype(np.uint64)
    gram = np.where(found.inside, gram, ~np.uint64(0))

    parts = count // rule.per_word + 1
    line = np.repeat(np.arange(len(lines)), parts)
    i = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    base, of = count[line] // parts[line], parts[line]
    wide = count[line] - base * of
    at = first[line] + i * base + np.maximum(0, i - (of - wide))
    bounds = np.stack([at, at + base + (i >= of - wide) - GRAM + 1], 1).ravel()
    least = np.minimum.reduceat(np.r_[gram, ~np.uint64(0)], bounds)[::2]
    chosen = [(line, least, False)]

    stretch = np.array([_stretch(rule, n) for n in count.tolist()])
    cuts = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lines)], strict=True):
        wide = int(stretch[lo])
        low, have = gram[first[lo] : first[hi - 1] + count[hi - 1]], 1
        while have < wide:
            step = min(have, wide - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        line = np.repeat(np.arange(lo, hi), count[lo:hi])[: len(low)]
        new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (line[1:] != line[:-1])])
        # a stretch that begins here and ends in the line
        new = new[place[first[lo] + new] + GRAM + wide - 1 <= count[line[new]]]
        line, low = line[new], low[new]
        # in a run of equal substrings some are enough, for places need not agree so closely
        same = (low[1:] >> np.uint64(12) == low[:-1] >> np.uint64(12)) & (low[1:] == low[:-1] + np.uint64(1)) & (line[1:] == line[:-1])
        begin = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(low)), 0))
        some = (np.arange(len(low)) - begin) % RUN == 0
        chosen.append((line[some], low[some], True))
    payload = np.uint64(WORDS) | (rule.size(count).astype(np.uint64) << np.uint64(12))
    out = [(line, _key(low >> np.uint64(12), probe, payload[line] | (low & np.uint64(FAR)))) for line, low, probe in chosen]
    line, key = (np.concatenate(x) for x in zip(*out, strict=True))
    return line, key, np.bitwise_xor.reduceat(np.uint64(1) << (found.word >> np.uint64(58)), first)


@lru_cache(maxsize=1 << 14)
def _stretch(rule: Rule, words: int) -> int:
    return rule.stretch(words)


NONE_FREQUENT = (np.empty(0, np.uint64), np.empty(0, np.int64))


def keys(lines: list[str], rule: Rule, frequent: tuple[np.ndarray, np.ndarray] = NONE_FREQUENT) -> Keys:
    """Line, key and sketch of all that lines file and probe with."""
    if rule.per_word is None:
        line, key, sketch = keys_of_characters(lines, rule)
        return line, key, sketch[line]
    words = np.array([len(line.split()) for line in lines])
    found = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))]
    # a line may be short of the words of another one by as many as there are edits
    short, long = np.flatnonzero(words < rule.per_word + rule.max_edits), np.flatnonzero(words >= rule.per_word)
    if len(short):
        line, key, sketch = keys_of_characters([lines[i] for i in short.tolist()], rule)
        found.append((short[line], key, sketch[line]))
    if len(long):
        long = long[np.argsort([_stretch(rule, n) for n in words[long].tolist()], kind="stable")]
        line, key, sketch = keys_of_words([lines[i] for i in long.tolist()], rule, *frequent)
        found.append((long[line], key, sketch[line]))
    line, key, sketch = (np.concatenate(x) for x in zip(*found, strict=True))
    return line, key, sketch


def identity(line: str) -> bytes:
    """128 bits that stand for a line."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _halves(ids: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Identities as two columns of signed numbers."""
    h = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
    return pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, h1, h2 of every line that is not white space alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, number, ids = [], [], []
            for i, text in enumerate(batch.column(2)):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    if line and not line.isspace():
                        doc.append(i)
                        number.append(k)
                        ids.append(identity(line))
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), *_halves(ids)], ["doc_id", "text_hash", "line_no", "h1", "h2"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, line_no int, h1 long, h2 long")


def _lines(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[list[str], list[bytes]]]:
    """Lines of texts that are long enough for an edit, some at a time, and their identities; hardly repeated within a task."""
    seen: set[bytes] = set()
    some, ids, held = [], [], 0
    for batch in batches:
        for text in batch.column(0):
            for line in (text.as_py() or "").split("\n"):
                if len(line) >= rule.shortest and not line.isspace():
                    h = identity(line)
                    if h in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    some.append(line)
                    ids.append(h)
                    held += len(line) + 1
                    if held >= CHARS:
                        yield some, ids
                        some, ids, held = [], [], 0
    if some:
        yield some, ids


def _frequent(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of substrings that many lines of a bounded sample have, sorted, and how frequent they are on a scale from 1 to 15."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in _lines(batches, rule):
            found = Grams.of(some)
            line = np.repeat(np.arange(len(some)), found.count)[: len(found.hash)][found.inside]
            pairs = np.unique(np.stack([line.astype(np.uint64), found.hash[found.inside]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], ["h"])

    if rule.per_word is None:
        return NONE_FREQUENT
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    some = sampled(known, F.col("doc_id"), SAMPLE, 42).select("text").mapInArrow(tidy(run), "h long")
    told = some.groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(TOLD).toArrow()
    h, count = told.column("h").to_numpy().view(np.uint64), told.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], np.minimum(15, 1 + np.log2(count[order] // FREQUENT)).astype(np.int64)


def _packed(docs: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """bucket and its keys, each with h1 and sketch, in rows of as many as a task meets at once."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, ids in _lines(batches, rule):
            line, key, sketch = keys(some, rule, frequent.value)
            if not len(line):
                continue
            h1 = np.frombuffer(b"".join(ids), "<i8")[::2]
            pairs = np.stack([key.view(np.int64), h1[line], sketch.view(np.int64)], 1)
            bucket = _bucket(key, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, data = bucket[order], pairs[order].tobytes()
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            offsets = np.r_[first, len(bucket)].astype(np.int32) * 24
            rows = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), rows], ["bucket", "pairs"])

    return docs.select("text").mapInArrow(tidy(run), "bucket int, pairs binary")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(HASH)).astype(np.int64) % buckets


def _unpacked(column: pa.Array) -> np.ndarray:
    """Key, h1 and sketch of what some rows hold."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.int64).reshape(-1, 3)


def _by_row(packed: DataFrame) -> DataFrame:
    """Every key of every line of a packed table once: key, h1, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = _unpacked(batch.column(1))
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16), c].copy()) for c in range(3)], ["key", "h1", "sketch"])

    return packed.mapInArrow(tidy(run), "key long, h1 long, sketch long").distinct()


def _meet(group: np.ndarray, key: np.ndarray, h1: np.ndarray, sketch: np.ndarray, rule: Rule, crowd: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a filed and a probing line of one group that may link, and the groups that hold too many. Sorted by group, then by key."""
    probe, of_words = (key & PROBES) > 0, (key & WORDS) > 0
    filed, probing = np.flatnonzero(~probe), np.flatnonzero(probe)
    # filed rows by group, kind, class of length and place; of characters all are met
    at = group * (2 * WORDS) + np.where(of_words, key & (2 * WORDS - 1), 0)
    size, place = key >> 12 & 255, key & FAR
    reach = rule.reach(size) if rule.per_word is not None else place
    flips, sketch = np.where(of_words, 2 * (reach - RUN), 4 * rule.max_edits), sketch.view(np.uint64)
    low = np.where(of_words, at - place + np.maximum(0, place - reach), at)
    high = np.where(of_words, at - place + np.minimum(FAR, place + reach), at)
    again = probing[of_words[probing] & (size[probing] > 0)]  # lines of the next smaller class
    asked = np.concatenate([probing, again])
    less = np.r_[np.zeros(len(probing), np.int64), np.full(len(again), FAR + 1)]
    begin = np.searchsorted(at[filed], low[asked] - less)
    count = np.searchsorted(at[filed], high[asked] - less, "right") - begin
    total = np.bincount(group[asked], count, int(group[-1]) + 1)
    crowded = np.flatnonzero(total > crowd)
    count[np.isin(group[asked], crowded)] = 0
    done, pairs = np.cumsum(count), []
    for lo in range(0, int(done[-1]) if len(done) else 0, PAIRS):
        some = np.arange(np.searchsorted(done, lo, "right"), np.searchsorted(done, lo + PAIRS, "right"))
        if not len(some):
            continue
        n = count[some]
        right = np.repeat(asked[some], n)
        left = filed[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        even = np.bitwise_count((key[left] ^ key[right]) & (WORDS - 1)) <= 2 * rule.max_edits
        near = np.bitwise_count(sketch[left] ^ sketch[right]) <= flips[right]
        hit = (of_words[right] | even) & near & (h1[left] != h1[right])
        one, two = h1[left[hit]], h1[right[hit]]
        pairs.append(np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1), axis=0))
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
    return found, crowded


MET = "u long, v long, crowded long, over int"


def _told(pairs: np.ndarray, crowded: np.ndarray, over: list[int]) -> Iterator[pa.RecordBatch]:
    """Pairs, keys that hold too many, and buckets that do."""
    n = [len(pairs), len(crowded), len(over)]
    if sum(n):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        u = pa.concat_arrays([pa.array(pairs[:, 0], kinds[0]), pa.nulls(n[1] + n[2], kinds[0])])
        v = pa.concat_arrays([pa.array(pairs[:, 1], kinds[1]), pa.nulls(n[1] + n[2], kinds[1])])
        c = pa.concat_arrays([pa.nulls(n[0], kinds[2]), pa.array(crowded, kinds[2]), pa.nulls(n[2], kinds[2])])
        o = pa.concat_arrays([pa.nulls(n[0] + n[1], kinds[3]), pa.array(over, kinds[3])])
        yield pa.RecordBatch.from_arrays([u, v, c, o], ["u", "v", "crowded", "over"])


def _groups(hashes: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Numbers that rise from one hash to the next, or where anything else changes."""
    new = hashes[1:] != hashes[:-1]
    for other in more:
        new = new | (other[1:] != other[:-1])
    return np.cumsum(np.r_[0, new])


def _meeting_in_buckets(packed: DataFrame, rule: Rule, crowd: float) -> DataFrame:
    """Rows of ``packed``, sorted by bucket -> pairs, crowded keys, and buckets that hold too many keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, n = None, [], 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(own)], strict=True):
                if bucket != own[lo]:
                    yield from answer(bucket, held, n)
                    bucket, held, n = int(own[lo]), [], 0
                pairs = _unpacked(batch.column(1).slice(lo, hi - lo))
                n += len(pairs)
                held = [*held, pairs] if n <= MOST else []
        yield from answer(bucket, held, n)

    def answer(bucket: int | None, held: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
        if n > MOST:
            yield from _told(np.empty((0, 2), np.int64), np.empty(0, np.int64), [bucket])
        elif n:
            key, h1, sketch = np.concatenate(held).T
            order = np.lexsort((h1, key))
            key, h1 = key[order], h1[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (h1[1:] != h1[:-1])]
            key, h1, sketch = key[new], h1[new], sketch[order[new]]
            at = _groups(key >> HASH)
            pairs, many = _meet(at, key, h1, sketch, rule, crowd)
            yield from _told(pairs, key[np.searchsorted(at, many)] >> HASH, [])

    return packed.mapInArrow(tidy(run), MET)


def _meeting(dealt: DataFrame, rule: Rule, crowd: float) -> DataFrame:
    """Rows (key, h1, sketch, and part if split), sorted by part and key -> pairs and crowded keys."""
    split = "part" in dealt.columns

    def group(rows: pa.RecordBatch) -> np.ndarray:
        return _groups(rows.column(0).to_numpy() >> HASH, *([rows.column(3).to_numpy()] if split else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, over = [], 0, None
        for batch in batches:
            if over is not None:  # the rest of a key that is known to be crowded
                batch = batch.slice(int(np.searchsorted(batch.column(0).to_numpy() >> HASH, over, "right")))
                over = None if batch.num_rows else over
            if not batch.num_rows:
                continue
            at = group(batch)
            last = int(np.searchsorted(at, at[-1]))
            if held and (last or group(joined([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))[-1]):
                now = joined([*held, batch.slice(0, last)])
                held, rows = [], 0
                yield from answer(now)
            elif last:
                yield from answer(batch.slice(0, last))
            held.append(batch.slice(last))
            rows += batch.num_rows - last
            if rows > MOST and split:  # filed rows come first, and a part has few of them
                now = joined(held)
                filed = int(((now.column(0).to_numpy() & PROBES) == 0).sum())
                yield from answer(now)
                held, rows = [now.slice(0, filed)] if filed else [], filed  # without filed rows the part has no pairs
            elif rows > MOST:
                over = held[0].column(0)[0].as_py() >> HASH
                held, rows = [], 0
                yield from _told(np.empty((0, 2), np.int64), np.array([over]), [])
        if held:
            yield from answer(joined(held))

    def joined(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    def answer(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, at = rows.column(0).to_numpy(), group(rows)
        pairs, many = _meet(at, key, rows.column(1).to_numpy(), rows.column(2).to_numpy(), rule, crowd)
        yield from _told(pairs, key[np.searchsorted(at, many)] >> HASH, [])

    return dealt.mapInArrow(tidy(run), MET)


def candidates(docs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (u, v) of lines, by the first half of their identity, that may link."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    packed = _packed(docs, rule, buckets)
    bare = F.shiftright("key", HASH)
    found = cut(_meeting_in_buckets(packed.repartition("bucket").sortWithinPartitions("bucket"), rule, CROWD).distinct())
    over = found.where(F.col("over").isNotNull()).select(F.col("over").alias("bucket"))
    pairs, crowded = (found.where(F.col(c).isNotNull()) for c in ("u", "crowded"))
    if not over.isEmpty():
        again = cut(_meeting(_by_row(packed.join(over, "bucket", "left_semi")).repartition(bare).sortWithinPartitions("key"), rule, CROWD).distinct())
        pairs, crowded = (one.unionByName(again.where(F.col(c).isNotNull())) for one, c in ((pairs, "u"), (crowded, "crowded")))
    pairs, crowded = pairs.select("u", "v"), crowded.select("crowded")
    if crowded.isEmpty():
        return pairs
    crowded = cut(crowded)
    few = crowded.count() <= BROADCAST_IDS  # then the rows of a crowded key stay where they are until it is split
    near = F.broadcast if few else lambda small: small
    of = F.pmod(F.col("crowded").bitwiseAND(F.lit((1 << (64 - HASH)) - 1)), F.lit(buckets)).cast("int")
    hot = _by_row(packed.join(near(crowded.select(of.alias("bucket")).distinct()), "bucket", "left_semi")).join(near(crowded), bare == F.col("crowded"))
    counted = cut(hot.groupBy("crowded").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    # every filed row goes to one part, every probing row to all parts
    own = F.array(F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int"))
    probes = F.col("key").bitwiseAND(F.lit(PROBES)) != 0
    split = hot.join(near(counted), "crowded").withColumn("part", F.explode(F.when(probes, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    dealt = split.select("key", "h1", "sketch", "part").repartition(bare, "part").sortWithinPartitions("part", "key")
    return cut(pairs.unionByName(_meeting(dealt, rule, float("inf")).select("u", "v")).distinct())


def verified(docs: DataFrame, rule: Rule) -> DataFrame:
    """What the links between different lines say: (u, v) joins two lines of a class, (u, null, links) counts links of a line. Lines are named by hexadecimal identities."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, at = np.unique(np.array(batch.column(2).to_pylist() + batch.column(3).to_pylist(), object), return_inverse=True) if batch.num_rows else ([], np.empty(0, int))
            ok = pa.array(linked(list(lines), at[: batch.num_rows], at[batch.num_rows :], rule))
            u, v = (batch.column(c).filter(ok).to_numpy(zero_copy_only=False).astype("U32") for c in (0, 1))
            if not len(u):
                continue
            names, links = np.unique(np.concatenate([u, v]), return_counts=True)
            nodes, roots = local_roots(u, v)
            u, v = nodes[nodes != roots], roots[nodes != roots]
            columns = [np.r_[u, names], np.r_[v, np.full(len(names), None)]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.tolist(), pa.string()) for c in columns), pa.array([None] * len(u) + links.tolist(), pa.int64())], ["u", "v", "links"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, own in _lines(batches, rule):
            yield pa.RecordBatch.from_arrays([*_halves(own), pa.array(some, pa.string())], ["h1", "h2", "line"])

    pairs = candidates(docs, rule)
    ids = cut(pairs.select(F.explode(F.array("u", "v")).alias("h1")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    lines = docs.select("text").mapInArrow(tidy(told), "h1 long, h2 long, line string").join(ids, "h1", "left_semi")
    lines = cut(lines.groupBy("h1", "h2").agg(F.first("line").alias("line")))
    named = lines.select("h1", _name(F.col("h1"), F.col("h2")).alias("name"), "line")
    left = named.select(F.col("h1").alias("u"), F.col("name").alias("a_name"), F.col("line").alias("a"))
    right = named.select(F.col("h1").alias("v"), F.col("name").alias("b_name"), F.col("line").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("a_name", "b_name", "a", "b")
    return cut(both.mapInArrow(tidy(verify), "u string, v string, links long"))


def _name(h1, h2):
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def _place(kind: DataType) -> Column:
    """A place in the corpus, first by doc_id, then by line; null without an id. Whole numbers make one number, which aggregates without sorting."""
    if isinstance(kind, IntegralType):
        return F.expr("cast(cast(doc_id as decimal(38,0)) * 4294967296 + line_no as decimal(38,0))")
    return F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "line_no"))


def _known(docs: DataFrame, rule: Rule) -> DataFrame:
    """Every line of every document: doc_id, text_hash, line_no, place, h1, h2, links, class_place."""
    found = occurrences(docs)
    placed = cut(found.withColumn("place", _place(found.schema["doc_id"].dataType)))
    first = placed.groupBy("h1", "h2").agg(F.min("place").alias("first_place"))
    told = verified(docs, rule)
    counted = told.where(F.col("v").isNull()).groupBy(F.col("u").alias("name")).agg(F.sum("links").alias("links"))
    reach = components(told.where(F.col("v").isNotNull()).select("u", "v")).withColumnRenamed("node", "name")
    member = cut(reach.join(counted, "name").select(F.conv(F.substring("name", 1, 16), 16, -10).cast("long").alias("h1"), F.conv(F.substring("name", 17, 16), 16, -10).cast("long").alias("h2"), "root", "links"))
    placed_member = cut(member.join(first, ["h1", "h2"]))
    of_class = placed_member.join(placed_member.groupBy("root").agg(F.min("first_place").alias("class_place")), "root").select("h1", "h2", "links", "class_place")
    known = first.join(of_class, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("class_place", "first_place").alias("class_place"))
    known = cut(known)  # so that both sides of the last join are shuffled for it alone and a common line can be split
    return placed.join(known, ["h1", "h2"])


def classes(docs: DataFrame, max_edits: int = 2, per_edit: int = 16, per_word: int | None = None) -> DataFrame:
    """Every line of every document: doc_id, line_no, class_doc_id, class_line_no, links, kept.

    The class is named by the place of its first line; ``links`` counts the
    other different lines within the allowed distance.
    """
    every = _known(docs, Rule(max_edits, per_edit, per_word))
    if isinstance(every.schema["doc_id"].dataType, IntegralType):
        own = (F.expr("cast(floor(class_place / 4294967296) as bigint)"), F.expr("cast(pmod(class_place, 4294967296) as int)"))
    else:
        own = (F.col("class_place.doc_id"), F.col("class_place.line_no"))
    kept = F.col("place").eqNullSafe(F.col("class_place")).alias("kept")
    return every.select("doc_id", "line_no", own[0].alias("class_doc_id"), own[1].alias("class_line_no"), "links", kept)


def _without(text: Column, gone: Column) -> Column:
    """A text without the lines of some numbers."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in batches:
            out = []
            for one, some in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
                barred = set(some or ())
                out.append(None if one is None else "\n".join(line for k, line in enumerate(one.split("\n")) if k not in barred))
            yield pa.array(out, pa.string())

    @F.arrow_udf("string")
    def strip(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from tidy(run)(batches)

    return strip(text, gone)


def deduplicate(docs: DataFrame, max_edits: int = 2, per_edit: int = 16, per_word: int | None = None) -> DataFrame:
    """``docs`` without the lines that are not the first of their class; no document is dropped.

    If there is a column ``n_chars``, it holds the length of the new text where that changed.
    """
    every = _known(docs, Rule(max_edits, per_edit, per_word))
    gone = every.where(~F.col("place").eqNullSafe(F.col("class_place")) & F.col("doc_id").isNotNull())
    # rows of one id and one text lose the same lines; those of other texts are told apart
    gone = gone.groupBy(F.col("doc_id").alias("_of"), "text_hash").agg(F.collect_set("line_no").alias("_gone"))
    row = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = row.join(gone, (F.col("_id") == F.col("_of")) & (F.col("_hash") == F.col("text_hash")), "left")
    changes = F.col("_gone").isNotNull()
    # only texts that change go to Python
    text = F.when(changes, _without(F.when(changes, F.col("_row.text")), F.col("_gone"))).otherwise(F.col("_row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(F.length(text).cast("long"))
    return joined.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
