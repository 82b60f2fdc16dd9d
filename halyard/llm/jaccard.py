"""Links between documents whose sets of word shingles are alike, found by an exact prefix join.

Two texts link if the Jaccard similarity of their sets of shingles (lower-cased
words) is ``similarity`` or more. Shingles have one order for all documents: those
that are frequent in a sample come last. The sample grows with the table, so that a
shingle of ``CROWD`` documents is frequent in a table of any size. Of two sets that alike one shingle
at least is among the first ``n - ceil(similarity * n) + 1`` of either, whatever the
order, so the sample decides what is quick but never what is found. Pairs that meet
at such a shingle, and whose sizes, places in the order and parities allow a link, are
verified on the whole sets (of 64-bit hashes). Parities are the counts, modulo 2, of a
set's shingles in 2,048 buckets; of two sets they differ in no more bits than shingles.

A text takes part once a task, whatever the number of copies. A shingle with more than
``CROWD`` rows is crowded and makes no pairs at first. In each of ``ROUNDS`` rounds every
text goes, with its whole set, to one of its crowded shingles, where sets are compared
and a forest of what links is passed on; that finds most links of a large group of near
copies at the cost of a few shingles, not of all that the group shares. Then, at every
crowded shingle that holds texts of several components, in parts of ``PART``, the texts
outside the largest component are held against all others, and only pairs of different
components whose parities allow a link are verified. So no component is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.graph import components
from halyard.llm.simhash import fingerprint
from halyard.llm.terms import sampled
from halyard.llm.workers import tidy
from halyard.session import cut

SEED = 42
#: Least documents of the sample, how many of them have a frequent shingle, and the frequent shingles kept at most.
SAMPLE, FREQUENT, KNOWN = 8000, 3, 1 << 20
#: Rows of a shingle beyond which sets are compared in place; sets of one part.
CROWD, PART, ROUNDS = 256, 2048, 2
#: Pairs compared at once, texts that a task remembers having sent, ids that are broadcast at most.
PAIRS, SEEN, BROADCAST_IDS = 1 << 19, 1 << 17, 1 << 19
#: Bits that say in which bucket a shingle is.
BUCKETS = 11


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the different shingles, sorted; fewer words than a shingle are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = (total ^ one[i : len(one) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def identity(words: list[bytes]) -> int:
    """A signed number that stands for a text."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words), SEED)).view(np.int64))


def least(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles that a set of ``n`` shares with any alike."""
    return np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64)


def ordered(own: np.ndarray, frequent: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shingles in the order of all documents."""
    if not len(frequent):
        return own
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    return own[np.lexsort((own, np.where(frequent[at] == own, count[at], 0)))]


def meet(key: np.ndarray, ident: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts that meet at a key and may link, and the keys that hold more than ``crowd`` rows. Sorted by key."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    after = np.repeat(np.where(count > crowd, 0, first + count), count)
    n = np.maximum(0, after - np.arange(len(key)) - 1)
    done, found = np.cumsum(n), []
    for lo in range(0, int(done[-1]) if len(done) else 0, PAIRS):
        some = np.arange(np.searchsorted(done, lo, "right"), np.searchsorted(done, lo + PAIRS, "right"))
        if not len(some):
            continue
        left = np.repeat(some, n[some])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        a, b = size[left], size[right]
        shared = np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)
        # at the first shingle that both have, nothing before it is shared
        hit = (np.minimum(a - place[left], b - place[right]) >= shared) & (ident[left] != ident[right])
        one, two = ident[left[hit]], ident[right[hit]]
        found.append(np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1), axis=0))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64), key[first[count > crowd]]


def sample_size(documents: int) -> int:
    """Documents of the sample: at least so many that a shingle of ``CROWD`` documents is expected in twice ``FREQUENT``."""
    return max(SAMPLE, -(-2 * FREQUENT * documents // CROWD))


def parity(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS) & 1).tobytes()


def apart(a: np.ndarray | int, b: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles that alike sets of these sizes may not share, in all."""
    return np.floor((np.asarray(a) + b) * (1 - similarity) / (1 + similarity) + 1e-9)


def outside(ident: np.ndarray, size: np.ndarray, bits: np.ndarray, component: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of sets of different components whose parities (rows of uint64) allow a link; every one that is not inside the largest component is held against all."""
    _, of, count = np.unique(component, return_inverse=True, return_counts=True)
    pairs = []
    for i in np.flatnonzero(of != count.argmax()):
        other = np.flatnonzero(of != of[i])
        differ = np.bitwise_count(bits[other] ^ bits[i]).sum(1, dtype=np.int64)
        near = other[differ <= apart(size[other], size[i], similarity)]
        pairs.append(np.stack([np.minimum(ident[near], ident[i]), np.maximum(ident[near], ident[i])], 1))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)


def alike(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared >= similarity * (len(one) + len(two) - shared) - 1e-9


def forest(ident: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among sets, breadth first: each is compared with those that nothing has reached yet, first by parity."""
    size = np.array([len(s) for s in sets])
    us, vs = [], []
    rest, todo = np.arange(len(sets)), []
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        pivot = todo.pop()
        differ = np.bitwise_count(bits[rest] ^ bits[pivot]).sum(1, dtype=np.int64)
        may = np.flatnonzero(differ <= apart(size[rest], size[pivot], similarity))
        if not len(may):
            continue
        many = np.concatenate([sets[i] for i in rest[may]])
        at = np.minimum(np.searchsorted(sets[pivot], many), size[pivot] - 1)
        of = size[rest[may]]
        shared = np.add.reduceat((sets[pivot][at] == many).astype(np.int64), np.cumsum(of) - of)
        near = may[shared >= similarity * (of + size[pivot] - shared) - 1e-9]
        us.append(ident[rest[near]])
        vs.append(np.full(len(near), ident[pivot]))
        todo.extend(rest[near])
        rest = np.delete(rest, near)
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
    return u, v


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole groups of rows with equal first columns, from sorted rows."""
    left = None
    for batch in batches:
        now = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        if not now.num_rows:
            continue
        key = np.stack([now.column(c).to_numpy() for c in range(columns)])
        last = int(np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])[-1])
        left = now.slice(last)
        if last:
            yield now.slice(0, last)
    if left is not None and left.num_rows:
        yield left


def links(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """(u, v): SimHash fingerprints (of ``width`` words) of documents that link; pairs of one fingerprint are left out."""
    spark = docs.sparkSession
    texts = docs.select("text").where(F.col("text").isNotNull())
    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    some = sampled(named, F.col("doc_id"), sample_size(docs.count()), SEED).select("text").mapInArrow(
        tidy(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(_words(t.as_py()), words) for t in b.column(0)] or [np.empty(0, np.uint64)]).view(np.int64))], ["h"]) for b in batches)), "h long"
    )
    # those of FREQUENT sampled documents or more; should they be more than KNOWN, of more documents
    often = cut(some.groupBy("h").count().where(F.col("count") >= FREQUENT))
    each = sorted(often.groupBy("count").agg(F.count("*").alias("n")).collect(), reverse=True)
    few = np.searchsorted(np.cumsum([r["n"] for r in each]), KNOWN, "right")
    top = often.where(F.col("count") > (each[few]["count"] if few < len(each) else 0)).toArrow()
    frequent, count = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], count[order]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for batch in batches:
            names, sizes, bits, keys = [], [], [], []
            for text in batch.column(0):
                split = _words(text.as_py())
                name = identity(split)
                if not split or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                own = shingles(split, words)
                names.append(name)
                sizes.append(len(own))
                bits.append(parity(own))
                keys.append(ordered(own, *known)[: len(own) - int(least(len(own), similarity)) + 1].view(np.int64))
            if names:
                first = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(first, pa.array(np.concatenate(keys)))], ["id", "size", "bits", "keys"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 1):
            found, many = meet(*(rows.column(c).to_numpy() for c in range(4)), similarity, CROWD)
            if len(found) or len(many):
                none = lambda n: pa.nulls(n, pa.int64())
                columns = [[pa.array(found[:, 0]), none(len(many))], [pa.array(found[:, 1]), none(len(many))], [none(len(found)), pa.array(many)]]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["u", "v", "crowded"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [_words(t.as_py()) for t in batch.column(0)]
            names = pa.array([identity(s) for s in split], pa.int64())
            yield pa.RecordBatch.from_arrays([names, batch.column(0)], ["id", "text"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            sets = [shingles(_words(t.as_py()), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(sets, pa.binary())], ["id", "fp", "own"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1), np.uint64) for c in (2, 4))
            ok = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= apart(batch.column(3).to_numpy(), batch.column(5).to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in (0, 1)], ["u", "v"])

    def parities(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 2):
            key = np.stack([rows.column(c).to_numpy() for c in range(2)])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            ident, size, bits, component = rows.column(2).to_numpy(), rows.column(3).to_numpy(), parities(rows.column(4)), rows.column(5).to_numpy()
            for lo, hi in zip(cuts, [*cuts[1:], len(size)], strict=True):
                found = outside(ident[lo:hi], size[lo:hi], bits[lo:hi], component[lo:hi], similarity)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in (1, 3))
            ok = pa.array([alike(x, y, similarity) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok)], ["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 2):
            key = np.stack([rows.column(c).to_numpy() for c in range(2)])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            ident, bits, sets = rows.column(2).to_numpy(), parities(rows.column(3)), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(4)]
            for lo, hi in zip(cuts, [*cuts[1:], len(sets)], strict=True):
                u, v = forest(ident[lo:hi], bits[lo:hi], sets[lo:hi], similarity)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def fetched(ids: DataFrame) -> DataFrame:
        """id, fp and own (the whole set) of some texts."""
        ids = cut(ids.distinct())
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        found = texts.mapInArrow(tidy(whole), "id long, text string").join(few, "id", "left_semi").mapInArrow(tidy(made), "id long, fp long, own binary")
        return cut(found.groupBy("id").agg(F.first("fp").alias("fp"), F.first("own").alias("own")))

    begun = cut(texts.mapInArrow(tidy(begin), "id long, size int, bits binary, keys array<long>"))
    spreaded = begun.select(F.posexplode("keys").alias("place", "key"), "id", "size").select("key", "id", "size", "place")
    met = cut(spreaded.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(pairs), "u long, v long, crowded long").distinct())
    sketches = begun.select("id", "size", "bits").groupBy("id").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    left, right = (sketches.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")) for c in "uv")
    meeting = met.where(F.col("u").isNotNull()).select("u", "v").join(left, "u").join(right, "v")
    meeting = cut(meeting.select("u", "v", "u_bits", "u_size", "v_bits", "v_size").mapInArrow(tidy(near), "u long, v long"))
    hot = met.where(F.col("crowded").isNotNull()).select(F.col("crowded").alias("key"))
    known = None
    if not hot.isEmpty():
        rows = cut(spreaded.join(hot, "key", "left_semi").select("key", "id").distinct())
        known = fetched(rows.select("id"))
        sketched = cut(sketches.join(known.select("id"), "id", "left_semi"))
        told = known.join(sketched.select("id", "bits"), "id").select("id", "bits", "own")
        joined = []
        for r in range(ROUNDS):
            chosen = rows.groupBy("id").agg(F.min_by("key", F.xxhash64("key", F.lit(SEED + r))).alias("key"))
            # a part holds PART sets in the mean; what lies in different parts is found below
            parts = chosen.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
            dealt = chosen.join(parts, "key").join(told, "id").select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long").alias("part"), "id", "bits", "own")
            joined.append(cut(dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(tidy(compare), "u long, v long")))
        joined = reduce(DataFrame.unionByName, joined)
        reach = components(joined)
        placed = cut(rows.join(reach, rows["id"] == reach["node"], "left").select("key", "id", F.coalesce("root", "id").alias("component")))
        several = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("a <> b").select("key", "parts")
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, own).cast("long") * (1 << 31) + F.greatest(o, own))
        dealt = placed.join(several, "key").withColumn("part", F.explode(every)).join(sketched, "id").select("key", "part", "id", "size", "bits", "component")
        more = dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(tidy(across), "u long, v long")
        meeting = cut(meeting.unionByName(more).distinct())
    ids = meeting.select(F.explode(F.array("u", "v")).alias("id"))
    sets = fetched(ids) if known is None else known.unionByName(fetched(ids.join(known.select("id"), "id", "left_anti")))
    left, right = (sets.select(F.col("id").alias(c), F.col("fp").alias(f"{c}_fp"), F.col("own").alias(f"{c}_own")) for c in "uv")
    both = meeting.join(left, "u").join(right, "v").select("u_fp", "u_own", "v_fp", "v_own").where("u_fp <> v_fp")
    found = both.mapInArrow(tidy(verify), "u long, v long")
    if known is not None:
        prints = sets.select("id", "fp")
        ends = joined.join(prints.select(F.col("id").alias("u"), F.col("fp").alias("u_fp")), "u").join(prints.select(F.col("id").alias("v"), F.col("fp").alias("v_fp")), "v")
        found = found.unionByName(ends.where("u_fp <> v_fp").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v")))
    return found.distinct()
