"""Exact nearest neighbours: physical plans.

Distances are ranked as sums of squared differences in double precision, ties by
id. A Gram product only proposes candidates, with a margin for its rounding, and
all proposals are then computed directly, so every plan ranks the same numbers.

Two plans, chosen by the measured size of the training side:

* it is at most ``broadcast_bytes``: it is broadcast, and queries stream past it
  without a shuffle;
* else queries are taken in blocks of at most ``block_bytes``, one after the other, so
  the driver holds one block however many there are; each block is broadcast, the
  training side streams past it, every task keeps its k best, and these short lists are
  merged. Neither side is shuffled.

Where vectors repeat, only the rows of least id at each of them can be among the k
nearest, and queries at one vector share their list: either plan then runs on these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import get_tuning
from halyard.functions.vectors import dense
from halyard.plans.blocks import blocks
from halyard.session import cut

#: Training rows from which queries in few partitions are dealt to all cores first.
SPREAD = 4096


def collected(df: DataFrame, dimensions: int) -> tuple[pa.Array, np.ndarray]:
    """A table of checked size on the driver, in the order of id."""
    table = df.select("id", "features").toArrow().sort_by("id").combine_chunks()
    if not table.num_rows:
        return pa.array([], table.schema.field(0).type), np.empty((0, dimensions))
    return table.column(0).chunk(0), dense(table.column(1), dimensions)


def fits(rows: int, dimensions: int) -> bool:
    return rows * (dimensions + 2) * 8 <= get_tuning().broadcast_bytes


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def proposals(q: np.ndarray, x: np.ndarray, k: int | None, radius2: float | None, barred: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may be among the k nearest, or within a radius, and their exact squared distances."""
    qn, xn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    rough = qn[:, None] + xn[None, :] - 2 * (q @ x.T)
    margin = 1e-12 * (q.shape[1] + 8) * (qn + xn.max(initial=0)) + 1e-300
    if barred is not None:
        rough[barred] = np.inf
    if k is not None:
        low = np.partition(rough, min(k, x.shape[0]) - 1, axis=1)[:, min(k, x.shape[0]) - 1] if x.shape[0] else np.zeros(len(q))
        near = rough <= (low + 2 * margin)[:, None]
    else:
        near = rough <= (radius2 + margin)[:, None]
    i, j = np.nonzero(near & np.isfinite(rough))
    gap = q[i] - x[j]
    d2 = np.einsum("ij,ij->i", gap, gap)
    if k is None:
        keep = d2 <= radius2
        i, j, d2 = i[keep], j[keep], d2[keep]
    return i, j, d2


def best(i: np.ndarray, j: np.ndarray, d2: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs sorted by query, distance and candidate, the first k of each query, with their rank."""
    order = np.lexsort((j, d2, i))
    i, j, d2 = i[order], j[order], d2[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k if k is not None else np.ones(len(i), bool)
    return i[keep], j[keep], d2[keep], rank[keep] + 1


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which pairs of rows have one id."""
    both = pa.concat_arrays([a.cast(b.type), b]).dictionary_encode().indices.to_numpy()
    return both[: len(a), None] == both[None, len(a) :]


def neighbors(queries: DataFrame, train: DataFrame, shape: tuple[int, int], k: int | None = None, radius: float | None = None, exclude_self: bool = False, label: bool = False) -> tuple[DataFrame, str]:
    """qid, rank, id, d2 of the k nearest (or of all within ``radius``), with ``label`` also the label of each, and the name of the plan.

    ``exclude_self`` is for queries that are the training rows.
    """
    if k is not None and _repeated(train, shape[0], k + exclude_self):
        return _collapsed(queries, train, shape[1], k, exclude_self, label)
    found, plan = _searched(queries, train, shape, k, radius, exclude_self)
    return found.join(train.select("id", "label"), "id") if label else found, plan


def _repeated(train: DataFrame, rows: int, most: int) -> bool:
    """Whether ``most`` rows of every vector are at most half of a table that is not small."""
    return rows >= SPREAD and 2 * most * train.agg(F.approx_count_distinct(F.xxhash64("features"))).first()[0] <= rows


def _collapsed(queries: DataFrame, train: DataFrame, dimensions: int, k: int, exclude_self: bool, label: bool) -> tuple[DataFrame, str]:
    most = k + exclude_self  # an id that is left out makes room for one more
    nth = F.dense_rank().over(Window.partitionBy("features").orderBy("id"))
    least = cut(train.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth"))
    shape = least.count(), dimensions
    labels = least.select("id", "label") if label else None
    if label and fits(shape[0], 2):
        labels = F.broadcast(labels)
    if not exclude_self:
        found, plan = _searched(queries, least, shape, k, None, False)
        return found.join(labels, "id") if label else found, plan
    places = least.groupBy("features").agg(F.min("id").alias("id"))
    found, plan = _searched(places, least, shape, most, None, False)
    found = found.join(labels, "id") if label else found
    columns = ["rank", "id", "d2", *(["label"] if label else [])]
    near = cut(found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("near")).join(places.withColumnRenamed("id", "qid"), "qid").select("features", "near"))
    near = F.broadcast(near) if fits(shape[0], dimensions + len(columns) * most) else near
    told = queries.select(F.col("id").alias("qid"), "features").join(near, "features")
    told = told.select("qid", F.posexplode(F.slice(F.filter("near", lambda n: n["id"] != F.col("qid")), 1, k)).alias("at", "n"))
    return told.select("qid", (F.col("at") + 1).alias("rank"), *(F.col(f"n.{c}").alias(c) for c in columns[1:])), plan


def _searched(queries: DataFrame, train: DataFrame, shape: tuple[int, int], k: int | None, radius: float | None, exclude_self: bool) -> tuple[DataFrame, str]:
    rows, dimensions = shape
    radius2 = None if radius is None else float(radius) ** 2
    if fits(rows, dimensions):
        cores = queries.sparkSession.sparkContext.defaultParallelism
        if rows >= SPREAD and queries.rdd.getNumPartitions() < cores:
            queries = queries.select("id", "features").repartition(cores)
        return _streamed_queries(queries, train, dimensions, k, radius2, exclude_self), "broadcast_train"
    return _streamed_train(queries, train, dimensions, k, radius2, exclude_self), "broadcast_query_blocks"


def _streamed_queries(queries: DataFrame, train: DataFrame, dimensions: int, k: int | None, radius2: float | None, exclude_self: bool) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(collected(train, dimensions))
    tile = get_tuning().tile_values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        step = max(1, tile // max(1, len(x)))
        for batch in batches:
            q, own = dense(batch.column(1), dimensions), batch.column(0)
            for lo in range(0, len(q) if len(x) else 0, step):
                part, mine = q[lo : lo + step], own.slice(lo, step)
                i, j, d2, rank = best(*proposals(part, x, k, radius2, _same(mine, ids) if exclude_self else None), k)
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(i)), pa.array(rank, pa.int32()), ids.take(pa.array(j)), pa.array(d2)], ["qid", "rank", "id", "d2"])

    return queries.select("id", "features").mapInArrow(run, f"qid {_kind(queries)}, rank int, id {_kind(train)}, d2 double")


def _streamed_train(queries: DataFrame, train: DataFrame, dimensions: int, k: int | None, radius2: float | None, exclude_self: bool) -> DataFrame:
    tuning = get_tuning()
    asked = queries.select("id", "features")
    many = max(1, -(-asked.count() * (dimensions + 2) * 8 // tuning.block_bytes))
    found = None
    for some in blocks(asked, F.col("id"), many):
        block = collected(some, dimensions)
        if not len(block[0]):
            continue
        part, shared = _block(train, queries, block, dimensions, k, radius2, exclude_self, tuning.tile_values)
        part = part if k is None else _ranked(part).where(F.col("rank") <= k)
        if many > 1:  # answered at once, and forgotten
            part = cut(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"qid {_kind(queries)}, rank int, id {_kind(train)}, d2 double")
    return (found if k is not None else _ranked(found)).select("qid", "rank", "id", "d2")


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id")))


def _block(train: DataFrame, queries: DataFrame, block: tuple[pa.Array, np.ndarray], dimensions: int, k: int | None, radius2: float | None, exclude_self: bool, tile: int) -> tuple[DataFrame, Broadcast]:
    """Candidates of a block of queries, and what is broadcast for it."""
    shared = train.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        step = max(1, tile // len(q))
        held = None
        for batch in batches:
            x, ids = dense(batch.column(1), dimensions), batch.column(0)
            for lo in range(0, len(x), step):
                some = ids.slice(lo, step)
                i, j, d2 = proposals(q, x[lo : lo + step], k, radius2, _same(own, some) if exclude_self else None)
                now = pa.table({"i": i, "d2": d2, "id": some.take(pa.array(j))})
                if k is None:
                    yield from told(own, now)
                    continue
                held = now if held is None else pa.concat_tables([held, now])
                if held.num_rows > 4 * k * len(q) + tile:
                    held = kept(held)
        if held is not None:
            yield from told(own, kept(held))

    def kept(held: pa.Table) -> pa.Table:
        held = held.sort_by([("i", "ascending"), ("d2", "ascending"), ("id", "ascending")])
        i = held.column("i").to_numpy()
        return held.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < k))

    def told(own: pa.Array, held: pa.Table) -> Iterator[pa.RecordBatch]:
        out = pa.table({"qid": own.take(held.column("i").combine_chunks()), "id": held.column("id"), "d2": held.column("d2")})
        yield from out.combine_chunks().to_batches()

    return train.select("id", "features").mapInArrow(run, f"qid {_kind(queries)}, id {_kind(train)}, d2 double"), shared


def closest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest center of each row, ties to the smallest index, and the exact squared distance."""
    label, least = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, get_tuning().tile_values // max(1, len(centers)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        i, j, d2, _ = best(*proposals(part, centers, 1, None, None), 1)
        label[lo + i], least[lo + i] = j, d2
    return label, least


def mapped(df: DataFrame, dimensions: int, columns: dict[str, str], compute: Callable[[np.ndarray], list[pa.Array]], source: str = "features") -> DataFrame:
    """``df`` with columns computed from a column of checked vectors, batch by batch."""
    # field names are quoted, for the schema is read back from text
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                more = compute(dense(batch.column(batch.schema.get_field_index(source)), dimensions))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *columns])

    return df.mapInArrow(run, ", ".join([schema, *(f"`{c}` {kind}" for c, kind in columns.items())]))
