"""Exact top-k search by inner product in three phases with a uniform threshold.

The candidates stay where they are, each task being a node with a list of local
scores. Phase 1 gathers from every node the best of its scores (lower bounds, in
single precision); the k-th of what is gathered for a query is a safe cutoff, for
k candidates at least reach it. Phase 2 broadcasts the cutoffs, and every node
collects the entries whose upper bound reaches the cutoff. Phase 3 resolves their
scores exactly in whole numbers; a node sends its k best at most, ties to the
smaller id, and the lists are merged (Cao and Wang, 2004, for a row-partitioned table).

Queries are taken in blocks of bounded size. Each block is read from a table that is
partitioned by block, broadcast, answered, and forgotten before the next one, so that
the driver and the executors hold one block, however many there are. Candidates are
scanned once a phase and block and never shuffled: copies of them for all blocks at
once would fill more disk than reading them again takes.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do rows without vec_id; vectors of unequal length are filled up with
zeros; equal scores rank by the smaller vec_id; rows that repeat a candidate's id
each take a place; of query rows with one id the least vector is the query; scores
beyond the range of a long are clamped; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.vectors import matrix, padded
from halyard.llm.workers import tidy
from halyard.session import checkpoint_dir, cut

#: Queries that are broadcast at once; scores held at once.
BLOCK, SCORES = 8192, 1 << 21


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows of whole numbers, clamped to the range of a long."""
    top = max(np.abs(a).max(initial=0), 1.0) * max(np.abs(b).max(initial=0), 1.0) * max(a.shape[1], 1)
    if top < 2.0**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


def _bounds(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in single precision, and how far they may be off."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = q.astype(np.float32), c.astype(np.float32)
        scores = a @ b.T
        norms = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
        small = max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * max(1, q.shape[1]) < 2**24
        off = 0.0 if small else (norms * (q.shape[1] + 4) * 2.0**-22)
    return scores, off


def _chunks(batches: Iterator[pa.RecordBatch], scale: int, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(16, SCORES // max(1, queries))
    for batch in batches:
        rows, x = matrix(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        known = np.asarray(batch.column(0).is_valid())[rows]
        rows, x = rows[known], np.floor(scale * x[known])
        for i in range(0, len(rows), step):
            yield ids[rows[i : i + step]].astype(np.int64), x[i : i + step]


def _block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: int) -> tuple[DataFrame, list[Broadcast]]:
    """The k best candidates of each of a block of queries: query_id, vec_id, score; and what is broadcast for it."""
    spark = vectors.sparkSession
    nodes = vectors.rdd.getNumPartitions()
    share = min(k, 3 * k // max(1, nodes) + 2)
    block = spark.sparkContext.broadcast((ids, queries))

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = block.value
        best = np.full((len(own), share), -np.inf)
        for got, c in _chunks(batches, scale, len(own)):
            width = max(q.shape[1], c.shape[1])
            scores, off = _bounds(padded(q, width), padded(c, width))
            low = np.where(own[:, None] == got[None, :], -np.inf, scores - off)
            both = np.concatenate([best, np.nan_to_num(low.astype(float), nan=-np.inf, posinf=np.finfo(float).max)], axis=1)
            best = -np.partition(-both, share - 1, axis=1)[:, :share]
        at, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best[np.isfinite(best)])], ["query", "low"])

    gathered = vectors.mapInArrow(tidy(local_lists), "query int, low double")
    order = Window.partitionBy("query").orderBy(F.desc("low"))
    found = gathered.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).where(F.col("place") == k).select("query", "low").collect()
    cutoffs = np.full(len(ids), -np.inf)
    for r in found:
        cutoffs[r["query"]] = r["low"]
    safe = spark.sparkContext.broadcast(cutoffs)

    def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, q), cutoff = block.value, safe.value
        at, vec, score = (np.empty(0, np.int64) for _ in range(3))
        for got, c in _chunks(batches, scale, len(own)):
            width = max(q.shape[1], c.shape[1])
            wide, c = padded(q, width), padded(c, width)
            scores, off = _bounds(wide, c)
            enough = np.nan_to_num((scores + off).astype(float), nan=np.inf, posinf=np.inf, neginf=np.inf) >= cutoff[:, None]
            i, j = np.nonzero(enough & (own[:, None] != got[None, :]))
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                at, vec, score = np.r_[at, a], np.r_[vec, got[b]], np.r_[score, exact(wide[a], c[b])]
                if len(at) > 4 * k * max(len(own), 1 << 12):
                    at, vec, score = _best(at, vec, score, k)
            at, vec, score = _best(at, vec, score, k)
        for lo in range(0, len(at), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(own[at[part]]), pa.array(vec[part]), pa.array(score[part])], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(tidy(sufficient), "query_id long, vec_id long, score long"), [block, safe]


def _best(at: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score, at))
    at, vec, score = at[order], vec[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], vec[keep], score[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` (vec_id, embedding) for each of ``queries``.

    A component x counts as floor(scale * x). A candidate with the query's own id is left out.
    """
    spark, rows = vectors.sparkSession, vectors.select("vec_id", "embedding")
    asked = queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // BLOCK))
    if blocks > 1:
        # written once, partitioned, so that a block is read without the others
        folder = f"{checkpoint_dir(spark)}/queries-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(folder)
    found = None
    for b in range(blocks):
        some = (spark.read.parquet(folder).where(F.col("block") == b) if blocks > 1 else asked).select("vec_id", "embedding").toArrow()  # of bounded size
        place, x = matrix(some.column("embedding"))
        if not len(place):
            continue
        ids = some.column("vec_id").to_numpy()[place].astype(np.int64)
        order = np.argsort(ids)
        part, shared = _block(rows, ids[order], np.floor(scale * x[order]), k, scale)
        part = _ranked(part, k)
        if blocks > 1:
            part = cut(part)
            for broadcast in shared:
                broadcast.destroy()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
