"""Packing of documents into sequences of fixed capacity by a grouping genetic algorithm.

``pieces`` turns documents into token pieces: a document of up to ``capacity``
tokens is one piece; a longer one is cut into pieces of ``capacity`` tokens, of
which the first holds the remainder. ``pack`` gives every piece a sequence and
an offset. Full pieces are sequences of their own. The others are dealt by hash
to groups of some ``GROUP`` pieces; each group is solved by ``ISLANDS`` islands,
every one in a task of its own, that evolve a small population for ``ROUNDS``
rounds and after each round send their elite to the next island of the ring.
A crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold an injected piece, and puts the displaced pieces back by best
fit. An island stops as soon as it needs no more sequences than the sum of the
lengths demands.

Defined results: a null or empty text is a piece of the end token alone;
repeated rows are packed once each; ids need not be unique; an empty table gives
an empty result; columns of ``pieces`` other than ``length`` are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.tokens import encoder
from halyard.llm.workers import tidy
from halyard.session import cut

GROUP = 32768
ISLANDS = 3
ROUNDS = 3
POPULATION = 6
CHILDREN = 60
#: Bytes of ids that one Arrow batch holds at most, but for a single piece.
BATCH = 1 << 22


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (binary: little-endian unsigned 32-bit) of every piece. For ``tokenizer`` and ``ranks`` see ``tokens.encoder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            ids, rows, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(tokens) % capacity or min(capacity, len(tokens))
                starts = [0, *range(first, len(tokens), capacity)]
                for i, start in enumerate(starts):
                    end = first if i == 0 else start + capacity
                    ids.append(tokens[start:end].tobytes())
                    rows.append((doc_id.as_py(), i, start, end - start))
                held += 4 * len(tokens)
                if held >= BATCH:
                    yield made(rows, ids, batch.schema.field(0).type)
                    ids, rows, held = [], [], 0
            if rows:
                yield made(rows, ids, batch.schema.field(0).type)

    def made(rows: list, ids: list, kind: pa.DataType) -> pa.RecordBatch:
        doc, piece, start, length = zip(*rows, strict=True)
        columns = [pa.array(doc, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


class _Bins:
    """Open bins by free space; best fit takes the fullest bin that has room."""

    def __init__(self, capacity: int) -> None:
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def add(self, bin_: int, room: int) -> None:
        if room > 0:
            if not self.by_room[room]:
                self.rooms |= 1 << room
            self.by_room[room].append(bin_)

    def take(self, size: int) -> tuple[int, int] | None:
        fits = self.rooms >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        return bin_, room


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the items of ``order`` (those with bin -1) into the bins of the others or new ones."""
    bins = bins.copy()
    placed = bins >= 0
    used = np.unique(bins[placed], return_inverse=True)
    bins[placed] = used[1]
    filled = np.bincount(bins[placed], sizes[placed], len(used[0])).astype(int)
    open_ = _Bins(capacity)
    for bin_ in np.flatnonzero(filled < capacity).tolist():
        open_.add(bin_, capacity - int(filled[bin_]))
    n = len(filled)
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        found = open_.take(size)
        if found is None:
            found, n = (n, capacity), n + 1
        bins[item] = found[0]
        open_.add(found[0], found[1] - size)
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven fills (few nearly empty bins rather than many half empty ones)."""
    fill = np.bincount(bins, sizes) / capacity
    return -len(fill), float(np.square(fill).sum())


def crossover(sizes: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: whole well-filled bins of ``other`` replace the bins of ``one`` that hold their items."""
    fill = np.bincount(other, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.9))
    chosen = rng.choice(good, max(1, len(good) // 2), replace=False)
    injected = np.isin(other, chosen)
    own = np.bincount(one, sizes)
    # mutation: some bins go too, the likelier the emptier they are
    room = capacity - own + 1e-3
    loose = rng.choice(len(own), min(len(own), max(2, len(own) // 10)), replace=False, p=room / room.sum())
    removed = np.isin(one, np.union1d(one[injected], loose))
    child = np.where(injected, other + len(own), np.where(removed, -1, one))
    displaced = np.flatnonzero(child < 0)
    return best_fit(sizes, displaced[np.lexsort((rng.random(len(displaced)), -sizes[displaced]))], child, capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, children: int) -> list[np.ndarray]:
    """A round of one island: children replace the worst members; best member first."""
    least = -(-int(sizes.sum()) // capacity)
    scored = [(fitness(sizes, p, capacity), p) for p in population]
    size = max(2, len(scored))
    for _ in range(children):
        scored.sort(key=lambda x: x[0], reverse=True)
        scored = scored[:size]
        if -scored[0][0][0] <= least or len(scored) < 2:
            break
        one, other = rng.choice(len(scored), 2, replace=False)
        child = crossover(sizes, scored[one][1], scored[other][1], capacity, rng)
        scored.append((fitness(sizes, child, capacity), child))
    scored.sort(key=lambda x: x[0], reverse=True)
    return [p for _, p in scored[:size]]


def near_fit(sizes: np.ndarray, capacity: int, slack: int) -> np.ndarray:
    """Bins begun with the largest item left and filled by one or two that leave ``slack`` at most, else by the largest that fits.

    Sizes present are the bits of a number, read from below and from above, so the pairs
    that fill a gap are the bits of one conjunction.
    """
    of: list[list[int]] = [[] for _ in range(capacity + 1)]
    for item, size in enumerate(sizes.tolist()):
        of[size].append(item)
    up = sum(1 << size for size in range(1, capacity + 1) if of[size])
    down = sum(1 << (capacity - size) for size in range(1, capacity + 1) if of[size])
    bins, n = np.full(len(sizes), -1), 0
    while up:
        gap, wanted = capacity, [up.bit_length() - 1]
        while wanted:
            for size in wanted:
                bins[of[size].pop()] = n
                gap -= size
                if not of[size]:
                    up ^= 1 << size
                    down ^= 1 << (capacity - size)
            wanted = []
            fits = up & ((1 << (gap + 1)) - 1)
            if not fits:
                break
            largest = fits.bit_length() - 1
            for left in range(slack + 1 if largest < gap - slack else 0):
                whole = gap - left
                pairs = up & (down >> (capacity - whole)) & ((1 << (whole // 2 + 1)) - 2)
                half = pairs.bit_length() - 1
                if pairs and 2 * half == whole and len(of[half]) < 2:
                    pairs ^= 1 << half
                    half = pairs.bit_length() - 1
                if pairs:
                    wanted = [half, whole - half]
                    break
            wanted = wanted or [largest]
        n += 1
    return bins


def first_population(sizes: np.ndarray, capacity: int, rng: np.random.Generator, size: int) -> list[np.ndarray]:
    """Near fits of different slack, best fit by falling length, and best fits in random order, which crossover has the more to take from."""
    none = np.full(len(sizes), -1)
    found = [near_fit(sizes, capacity, 1 + int(slack)) for slack in rng.permutation(4)[: size // 2]]
    found.append(best_fit(sizes, np.lexsort((rng.random(len(sizes)), -sizes)), none, capacity))
    while len(found) < size:
        found.append(best_fit(sizes, rng.permutation(len(sizes)), none, capacity))
    return found


def pack(found: DataFrame, capacity: int = 1024, seed: int = 42) -> DataFrame:
    """``found`` (any columns, and ``length``) with the columns sequence_id and offset."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            keys = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([keys, batch.column(0)], ["key", "row"])

    row = F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("row")
    kind = found.select(row).schema["row"].dataType.simpleString()
    held = cut(found.select(row).mapInArrow(tidy(keyed), f"key long, row {kind}"))
    small = held.where(F.col("row.length") < capacity)
    n = small.count()
    groups = max(1, -(-n // GROUP))

    def islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A round: state -> state and elite. An empty population is a first one."""
        for batch in batches:
            for x in batch.to_pylist():
                sizes = np.frombuffer(x["sizes"], "<i4").astype(int)
                rng = np.random.default_rng((seed, x["grp"], x["island"], x["round"]))
                members = [np.frombuffer(p, "<i4").astype(int) for p in x["members"]] or first_population(sizes, capacity, rng, POPULATION)
                members = evolve(sizes, members, capacity, rng, CHILDREN)
                score = fitness(sizes, members[0], capacity)
                x |= {"members": [m.astype("<i4").tobytes() for m in members], "round": x["round"] + 1, "bins": -score[0], "fill": score[1]}
                yield pa.RecordBatch.from_pylist([x], batch.schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                sizes, bins = np.frombuffer(x["sizes"], "<i4").astype(int), np.frombuffer(x["best"], "<i4").astype(int)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                before = ends - sizes[order]
                first = np.r_[True, bins[order][1:] != bins[order][:-1]]
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x["keys"])[order]), pa.array((x["grp"] << 24) + bins[order]), pa.array(offset)], ["key", "bin", "offset"])

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows = [{"grp": x["grp"], "island": i, "round": 0, "sizes": np.array(x["lengths"], "<i4").tobytes(), "members": [], "bins": 0, "fill": 0.0} for i in range(ISLANDS)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    shape = "grp long, island int, round int, sizes binary, members array<binary>, bins long, fill double"
    schema = pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("round", pa.int32()), ("sizes", pa.binary()), ("members", pa.list_(pa.binary())), ("bins", pa.int64()), ("fill", pa.float64())])
    grouped = small.select(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups)).alias("grp"), F.struct((-F.col("row.length")).alias("n"), "key").alias("item")).groupBy("grp").agg(F.sort_array(F.collect_list("item")).alias("items"))
    grouped = cut(grouped.select("grp", F.transform("items", lambda i: i["key"]).alias("keys"), F.transform("items", lambda i: (-i["n"]).cast("int")).alias("lengths")))
    now = grouped.select("grp", "lengths").mapInArrow(tidy(state), shape)
    for _ in range(ROUNDS):
        now = cut(now.repartition("grp", "island").mapInArrow(tidy(islands), shape))
        sent = now.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("members", 1).alias("elite"))
        now = now.join(sent, ["grp", "island"]).withColumn("members", F.concat("members", F.array("elite"))).drop("elite").select(*schema.names)
    best = now.groupBy("grp").agg(F.max_by(F.struct("sizes", F.element_at("members", 1).alias("best")), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("s"))
    solved = best.join(grouped.select("grp", "keys"), "grp").select("grp", "keys", "s.sizes", "s.best").mapInArrow(tidy(placed), "key long, bin long, offset long")
    together = held.join(solved, "key", "left")
    sequence = F.when(F.col("bin").isNull(), F.col("key") * 2 + 1).otherwise(F.col("bin") * 2)
    return together.select("row.*", sequence.alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
