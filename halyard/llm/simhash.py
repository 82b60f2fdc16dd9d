"""Near-duplicate documents by SimHash, linked with anchor points.

Fingerprints of 64 bits link at ``threshold`` or fewer differing bits. The bits
are cut into three blocks; of two linked fingerprints one block at least differs
in ``threshold // 3`` bits or fewer. In each block the anchors are the words of
a covering code: the Hamming code of length 15, which covers its space with
radius 1, beside the block's other bits taken as they are. A fingerprint has its
home at the anchor nearest to it, and is replicated to every anchor that lies
within the covering radius plus the threshold and can be the home of a
fingerprint linked to it. So linked fingerprints meet at the home of either, and
only fingerprints of one anchor are compared.

Equal texts share a fingerprint, which takes part once, whatever the number of
copies. An anchor with more than ``HOT`` fingerprints is split into pairs of
parts, each compared in a task of its own, so no link is lost and no group is
unbounded. Of what links at an anchor only a spanning forest is passed on.

Defined results: null and empty texts, and texts of white space, have the
fingerprint zero, linked like any other; fewer words than a shingle count as one
shingle; repeated rows get equal results; a null ``doc_id`` is never the
smallest of a component (a component without ids has a null one); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.graph import components, local_roots
from halyard.llm.workers import tidy
from halyard.session import cut

SEED = 42
#: First bit and number of bits of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Length of the covering code; the other bits of a block are taken as they are.
CODE = 15
#: An anchor with more fingerprints than this is split.
HOT = 100_000
#: Pairs compared at once.
PAIRS = 1 << 20


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the shingles of ``width`` words: a bit is 1 if it is set in over half the hashes."""
    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(gaps) < width:
        return xxhash.xxh64_intdigest(flat, SEED)
    starts = [0, *(gaps[: len(gaps) - width + 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _homes() -> np.ndarray:
    """The nearest word of the Hamming code for each of the 2 ** 15 words."""
    word = np.arange(1 << CODE)
    syndrome = np.zeros_like(word)
    for bit in range(CODE):
        syndrome ^= np.where(word >> bit & 1, bit + 1, 0)
    return np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)


HOMES = _homes()


def _ball(bits: int, radius: int) -> np.ndarray:
    """Masks of ``bits`` bits with ``radius`` bits set at most."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << b for m in masks for b in range(bits)}
    return np.array(sorted(masks), np.int64)


def home(fingerprints: np.ndarray, block: int) -> np.ndarray:
    """The anchor nearest to each fingerprint (uint64) in a block."""
    first, bits = BLOCKS[block]
    part = (fingerprints >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
    return block << 32 | (part >> CODE) << CODE | HOMES[part & ((1 << CODE) - 1)]


def anchors(fingerprints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Every anchor of every fingerprint: anchor, and position in ``fingerprints``."""
    found, rows = [], []
    for block, (first, bits) in enumerate(BLOCKS):
        around = _ball(bits, threshold // len(BLOCKS)).astype(np.uint64) << np.uint64(first)
        near = np.sort(home(fingerprints[:, None] ^ around[None, :], block), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        found.append(near[new])
        rows.append(np.nonzero(new)[0])
    return np.concatenate(found), np.concatenate(rows)


def _compare(group: np.ndarray, anchor: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one group, reduced to a forest. ``group`` is sorted."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    at_home = np.zeros(len(prints), bool)
    for block in range(len(BLOCKS)):
        mine = anchor >> 32 == block
        at_home[mine] = home(prints[mine], block) == anchor[mine]
    start, count = np.repeat(first, size), np.repeat(size, size)
    us, vs = [], []
    small = np.flatnonzero(at_home & (count > 1) & (count <= 2048))
    done = np.cumsum(count[small])
    for lo in range(0, int(done[-1]) if len(done) else 0, PAIRS):
        some = small[np.searchsorted(done, lo, "right") : np.searchsorted(done, lo + PAIRS, "right")]
        if not len(some):
            continue
        n = count[some]
        left = np.repeat(some, n)
        right = np.repeat(start[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        hit = (np.bitwise_count(prints[left] ^ prints[right]) <= threshold) & (left != right)
        us.append(prints[left[hit]])
        vs.append(prints[right[hit]])
    for lo, n in zip(first[size > 2048], size[size > 2048], strict=True):
        # breadth first: each fingerprint is compared with those that nothing has reached yet
        rest, todo = prints[lo : lo + n], []
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            pivot = todo.pop()
            near = np.bitwise_count(rest ^ pivot) <= threshold
            if near.any():
                reached = rest[near]
                us.append(reached)
                vs.append(np.full(len(reached), pivot))
                todo.extend(reached)
                rest = rest[~near]
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    nodes, roots = local_roots(np.concatenate(us), np.concatenate(vs))
    return nodes[nodes != roots], roots[nodes != roots]


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and the fingerprint (long, its bits taken as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def links(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """``prints`` (fp, each once) -> (u, v): a set of links with the same components as all links."""
    if threshold // len(BLOCKS) > 2:
        raise ValueError("thresholds of 0 to 8 bits are supported")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(own), 1 << 13):
                anchor, row = anchors(own[i : i + (1 << 13)], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[i + row].view(np.int64))], ["anchor", "fp"])

    def group(rows: pa.RecordBatch) -> np.ndarray:
        """Numbers that rise from one anchor or part to the next."""
        anchor, part = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        return np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            if not now.num_rows:
                continue
            at = group(now)
            last = int(np.searchsorted(at, at[-1]))
            left = now.slice(last)
            if last:
                yield from answer(now.slice(0, last), at[:last])
        if left is not None and left.num_rows:
            yield from answer(left, group(left))

    def answer(rows: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = _compare(at, rows.column(0).to_numpy(), rows.column(1).to_numpy().view(np.uint64), threshold)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    spreaded = prints.select("fp").mapInArrow(tidy(spread), "anchor long, fp long")
    crowded = cut(spreaded.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.ceil(2 * F.col("count") / HOT).cast("int").alias("parts")))
    if crowded.isEmpty():
        parted = spreaded.withColumn("part", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(other, own).cast("long") * (1 << 31) + F.greatest(other, own))
        parted = spreaded.join(crowded, "anchor", "left").withColumn("part", F.explode(F.coalesce(pairs, F.array(F.lit(0).cast("long"))))).select("anchor", "fp", "part")
    dealt = parted.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(tidy(compare), "u long, v long")


def groups(docs: DataFrame, width: int = 4, threshold: int = 4, more: DataFrame | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row. ``more`` are further links (u, v) of fingerprints."""
    prints = cut(fingerprints(docs, width))
    each = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = links(each, threshold)
    reach = components(linked if more is None else linked.unionByName(more))
    joined = cut(each.join(reach, each["fp"] == reach["node"]).select("fp", "root", "first_id"))
    ids = joined.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = joined.join(ids, "root").select("fp", "least_id")
    # cut, so that both sides of the last join are shuffled for it alone and a crowded fingerprint can be split
    known = cut(each.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 4, threshold: int = 4, more: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, one row a document.

    Of rows with one doc_id the one with the least hash of all its columns stays. Rows
    without a doc_id cannot be told apart and stay.
    """
    kept = groups(docs, width, threshold, more).where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("_kept_id")).agg(F.count("*").alias("_rows"))
    kept = cut(kept)
    once, more_often = kept.where(F.col("_rows") == 1), kept.where(F.col("_rows") > 1)
    found = docs.join(once, docs["doc_id"] == once["_kept_id"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    if more_often.isEmpty():
        return found
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    many = docs.join(more_often, docs["doc_id"] == more_often["_kept_id"], "left_semi")
    one = many.select(F.col("doc_id").alias("_id"), row.alias("_row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_hash"))
    return found.unionByName(one.groupBy("_id").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*"))
