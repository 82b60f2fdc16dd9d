"""Approximate nearest neighbours by cosine with balanced posting lists.

A bounded sample is split again and again along the line between two means, at
the median, so all lists are of like size; the means of the parts are the
centroids (on the unit sphere, where nearness by cosine is nearness). Centroids
are linked to their nearest ones and a few random ones, and that graph, held in
memory, is searched best first. Every vector goes to the list of its nearest
centroid; a vector at a boundary is replicated to further lists whose centroid is
about as near, unless a chosen centroid is nearer to that centroid than the vector
is. A query visits all lists whose centroid is at most ``ratio`` times as far as
the nearest one: where the search front is full before that bound is met, the query
is compared with every centroid. The ratio is found on the sample, from distances to
all centroids, where neighbours are sparser than in the whole and so harder to find
(Chen et al., 2021).

Long lists are split by hash into parts of bounded size. A task holds a part, and the
list's queries stream past it, so vectors are shuffled once for every list they are in,
and queries once for every part; only where a list has more queries than ``ASKED`` are
these split too, and its vectors copied for each split. So a list of any length is
searched in full, and no key grows without bound. Scores are computed in double
precision on the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without vec_id; shorter vectors are filled up with zeros;
equal scores rank by the smaller vec_id; rows that repeat a candidate's id each take
a place; of query rows with one id the least vector is the query; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.terms import sampled
from halyard.llm.vectors import matrix, padded
from halyard.llm.workers import tidy
from halyard.session import cut

#: Vectors the index is fitted on, aimed size of a list, most centroids.
SAMPLE, LIST, CENTROIDS = 20_000, 400, 4096
#: Links of a centroid, random links, length of the search front.
LINKS, RANDOM, FRONT = 16, 4, 64
#: Most lists a vector is in, and how much farther than the first they may be.
COPIES, NEAR = 4, 1.15
#: Share of neighbours that the ratio must find on the sample, and queries that tell.
RECALL, PROBES = 0.96, 300
#: Vectors of one part of a list, queries that stream past it at most; scores held at once.
PART, ASKED, SCORES = 8192, 1 << 20, 1 << 20


@dataclass
class Index:
    """Unit centroids, their graph, where a search begins, and the ratio of a query's search."""

    centroids: np.ndarray
    links: np.ndarray
    entry: np.ndarray
    ratio: float


def _unit(x: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(1, keepdims=True)
    x = x / np.where(peak > 0, peak, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def balanced(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Unit means of ``lists`` parts of like size."""
    parts = [(np.arange(len(x)), max(1, min(lists, len(x))))]
    means = []
    while parts:
        own, n = parts.pop()
        if n == 1:
            means.append(x[own].mean(0))
            continue
        ends = x[rng.choice(own, 2, replace=False)]
        for _ in range(6):
            side = (x[own] @ (ends[1] - ends[0])) > 0.5 * (np.square(ends[1]).sum() - np.square(ends[0]).sum())
            if side.all() or not side.any():
                break
            ends = np.stack([x[own[~side]].mean(0), x[own[side]].mean(0)])
        order = np.argsort(x[own] @ (ends[1] - ends[0]), kind="stable")
        half = len(own) * (n // 2) // n
        parts += [(own[order[:half]], n // 2), (own[order[half:]], n - n // 2)]
    means = _unit(np.array(means))
    return np.unique(means[np.isfinite(means).all(1)], axis=0)


def graph(centroids: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Links from each centroid to its nearest and to random ones; entries of a search."""
    n = len(centroids)
    near = np.empty((n, min(LINKS, n)), np.int64)
    for i in range(0, n, 512):
        far = _far(centroids[i : i + 512], centroids)
        near[i : i + 512] = np.argsort(far, axis=1, kind="stable")[:, : near.shape[1]]
    return np.concatenate([near, rng.integers(0, n, (n, RANDOM))], axis=1), np.unique(rng.integers(0, n, 16))


def walk(x: np.ndarray, index: Index, front: int = FRONT) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the graph for all rows of ``x`` at once: centroids and distances, nearest first."""
    n, c = len(x), len(index.centroids)
    front = min(front, c)
    seen = np.zeros((n, c), bool)
    ids = np.broadcast_to(index.entry, (n, len(index.entry)))[:, :front].copy()
    seen[:, index.entry] = True
    far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", x, index.centroids[ids])))
    done = np.zeros(ids.shape, bool)
    rows = np.arange(n)[:, None]
    while not done.all():
        # expand the nearest open centroids of every row
        order = np.argsort(np.where(done, np.inf, far), axis=1)[:, : min(4, ids.shape[1])]
        opened = ~np.take_along_axis(done, order, 1)
        np.put_along_axis(done, order, True, 1)
        more = index.links[np.take_along_axis(ids, order, 1)].reshape(n, -1)
        more = np.sort(np.where(np.repeat(opened, index.links.shape[1], 1), more, c), axis=1)
        fresh = (more < c) & np.concatenate([np.ones((n, 1), bool), more[:, 1:] != more[:, :-1]], axis=1)
        fresh &= ~seen[rows, np.minimum(more, c - 1)]
        at, column = np.nonzero(fresh)
        seen[at, more[at, column]] = True
        new = np.full(more.shape, np.inf)
        new[at, column] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", x[at], index.centroids[more[at, column]])))
        ids = np.concatenate([ids, np.where(fresh, more, 0)], 1)
        far = np.concatenate([far, new], 1)
        done = np.concatenate([done, ~fresh], 1)
        keep = np.argsort(far, axis=1, kind="stable")[:, :front]
        ids, far, done = (np.take_along_axis(a, keep, 1) for a in (ids, far, done))
    return ids, far


def lists_of(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The lists that unit vectors belong to: row, list."""
    ids, far = walk(x, index, 16)
    rows, lists = [np.arange(len(x))], [ids[:, 0]]
    chosen = ids[:, :1]
    for k in range(1, min(ids.shape[1], 2 * COPIES)):
        ok = np.isfinite(far[:, k]) & (far[:, k] <= NEAR * far[:, 0]) & ((chosen >= 0).sum(1) < COPIES)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", index.centroids[ids[:, k]], index.centroids[chosen])))
        ok &= (np.where(chosen >= 0, between, np.inf) >= far[:, k, None]).all(1)
        rows.append(np.flatnonzero(ok))
        lists.append(ids[ok, k])
        chosen = np.concatenate([chosen, np.where(ok, ids[:, k], -1)[:, None]], axis=1)
    return np.concatenate(rows), np.concatenate(lists)


def visited(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The lists that unit queries visit, all within the ratio: row, list."""
    near, far = walk(x, index)
    ok = np.isfinite(far) & (far <= index.ratio * far[:, :1] + 1e-12)
    # a front that ends within the bound may have left lists out
    full = np.flatnonzero(ok.all(1) & (near.shape[1] < len(index.centroids)))
    ok[full] = False
    at, column = np.nonzero(ok)
    rows, lists = [at], [near[at, column]]
    for i in range(0, len(full), 256):
        far = _far(x[full[i : i + 256]], index.centroids)
        at, column = np.nonzero(far <= index.ratio * far.min(1, keepdims=True) + 1e-12)
        rows.append(full[i + at])
        lists.append(column)
    return np.concatenate(rows), np.concatenate(lists)


def fit(vectors: DataFrame, seed: int = 42, k: int = 5) -> Index | None:
    """An index fitted on about SAMPLE vectors; None if there are none."""
    n = vectors.count()
    some = sampled(vectors.select("vec_id", "embedding"), F.col("vec_id"), SAMPLE, seed).toArrow()
    _, x = matrix(some.column("embedding"))
    x = x[(x != 0).any(1)]
    if not len(x):
        return None
    x = _unit(x)
    x = x[np.lexsort(x.T)]
    rng = np.random.default_rng(seed)
    centroids = balanced(x, int(np.clip(n // LIST, 1, min(CENTROIDS, max(1, len(x) // 8)))), rng)
    index = Index(centroids, *graph(centroids, rng), 1.0)
    # the smallest ratio that finds enough of the true neighbours
    asked = rng.choice(len(x), min(PROBES, len(x)), replace=False)
    true = np.concatenate([np.argsort(-(x[asked[i : i + 32]] @ x.T), axis=1, kind="stable")[:, 1 : k + 1] for i in range(0, len(asked), 32)])
    far = _far(x[asked], centroids)
    member: dict[int, set[int]] = {t: set() for t in np.unique(true).tolist()}
    some = np.array(sorted(member))
    for i in range(0, len(some), 1024):
        rows, lists = lists_of(x[some[i : i + 1024]], index)
        for r, c in zip(some[i + rows].tolist(), lists.tolist(), strict=True):
            member[r].add(c)
    needed = []
    for q, neighbours in enumerate(true.tolist()):
        ratios = far[q] / max(far[q].min(), 1e-12)
        needed += [min(ratios[c] for c in member[t]) for t in neighbours]
    if needed:
        index.ratio = float(np.sort(needed)[min(len(needed) - 1, int(RECALL * len(needed)))])
    index.ratio = min(max(index.ratio, 1.05) * 1.02, 1e9)
    return index


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of ``vectors`` (vec_id, embedding) for each of ``queries``."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    asked = queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    index = fit(rows, seed, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)

    def dealt(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            width = own.centroids.shape[1]
            at_row = TaskContext.get().partitionId() << 36
            for batch in batches:
                place, x = matrix(batch.column(1))
                place, x = place[(x != 0).any(1)], x[(x != 0).any(1)]
                ids = batch.column(0).to_numpy(zero_copy_only=False)[place].astype(np.int64)
                numbers = at_row + place
                at_row += batch.num_rows
                for i in range(0, len(x), 1024):
                    part = x[i : i + 1024]
                    unit = padded(_unit(part), width)[:, :width]
                    if query:
                        at, lists = visited(unit, own)
                    else:
                        at, lists = lists_of(unit, own)
                    data = [part[j].tobytes() for j in at]
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(ids[i : i + 1024][at]), pa.array(numbers[i : i + 1024][at]), pa.array(data, pa.binary())], ["list", "id", "row", "x"])

        return run

    kind = "list int, id long, row long, x binary"
    posted = cut(rows.mapInArrow(tidy(dealt(False)), kind))
    sought = cut(asked.mapInArrow(tidy(dealt(True)), kind))
    # the number of lists is bounded by CENTROIDS, and so are these counts
    size = posted.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    wants = sought.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("askers"))
    counts = F.broadcast(size.join(wants, "list"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of = lambda n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    left = posted.join(counts, "list").select("list", of("parts").alias("part"), F.explode(every("askers")).alias("asker"), F.lit(0).alias("kind"), "id", "row", "x")
    right = sought.join(counts, "list").select("list", F.explode(every("parts")).alias("part"), of("askers").alias("asker"), F.lit(1).alias("kind"), "id", "row", "x")
    together = left.unionByName(right).repartition("list", "part", "asker").sortWithinPartitions("list", "part", "asker", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, part = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if key != tuple(keys[lo, :3]):
                    key, parts, part = tuple(keys[lo, :3]), [], None
                own, number = batch.column(4).to_numpy()[lo:hi], batch.column(5).to_numpy()[lo:hi]
                x = stacked([np.frombuffer(v.as_buffer(), float) for v in batch.column(6).slice(lo, hi - lo)])
                if keys[lo, 3] == 0:
                    parts.append((own, number, x))
                elif parts:
                    if part is None:
                        width = max(x.shape[1] for _, _, x in parts)
                        part = [np.concatenate([p[c] for p in parts]) for c in (0, 1)] + [_unit(np.concatenate([padded(x, width) for *_, x in parts]))]
                    step = max(1, SCORES // len(part[0]))
                    for i in range(0, len(x), step):
                        yield nearest(x[i : i + step], own[i : i + step], part)

    def stacked(xs: list[np.ndarray]) -> np.ndarray:
        width = max(map(len, xs))
        return np.array([np.pad(x, (0, width - len(x))) if len(x) < width else x for x in xs])

    def nearest(q: np.ndarray, qid: np.ndarray, part: list[np.ndarray]) -> pa.RecordBatch:
        """The k nearest of a part, of unit vectors, to each of some queries."""
        own, number, x = part
        width = max(q.shape[1], x.shape[1])
        a, b = _unit(padded(q, width)), padded(x, width)
        rough = np.where(qid[:, None] == own[None, :], -np.inf, a @ b.T)
        floor = np.partition(rough, -min(k, len(own)), axis=1)[:, -min(k, len(own))][:, None] - 1e-9
        i, j = np.nonzero((rough >= floor) & np.isfinite(rough))
        score = np.einsum("nd,nd->n", a[i], b[j])
        order = np.lexsort((own[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[keep], j[keep]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (qid[i], own[j], number[j], score[keep])], ["query_id", "vec_id", "row", "score"])

    found = together.mapInArrow(tidy(compare), "query_id long, vec_id long, row long, score double")
    found = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
