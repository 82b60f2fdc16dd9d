"""Mixing of sources to target weights by capped water-filling.

Every source gets a share of the total size in proportion to its weight. No
source may be used more than ``max_epochs`` times: a source whose share exceeds
that is clamped, and the excess goes to the others by weight until none is
above its cap. Inside a source every document is repeated ``floor(epochs)``
whole times; the rest of the target is filled by one more pass over the
documents in a seeded random order, which stops at the target, so that the last
document of that pass is taken in part.

Defined results: a null text has size 0; an empty text has size 0 and takes 0;
a null source is a source of its own, which sorts last; a null ``doc_id`` is a
row like any other; rows that are equal in id and size are interchangeable; an
empty table gives an empty result; other columns are ignored by ``plan`` and
kept by ``materialize``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.session import cut
from halyard.sources.tables import numbered

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that name a slice of a source; the slice in
#: which the target is reached is the only one that is sorted by document.
SLICE_DIGITS = 3
#: Up to this many sources are shared out on the driver, else by rounds of aggregates.
DRIVER_SOURCES = 200_000
#: Up to this many sources the table of sources is broadcast, else it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, max_epochs: float) -> np.ndarray:
    """Targets that share ``total`` by weight, none above ``max_epochs`` times its size.

    Sources saturate in the order of cap / weight, so one sorted pass finds the
    common level: target = min(cap, level * weight).
    """
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    cap = size * max_epochs
    if not len(size):
        return cap
    ratio = cap / weight
    order = np.lexsort((np.arange(len(size)), ratio))
    left = total - np.concatenate([[0.0], np.cumsum(cap[order])[:-1]])
    share = np.cumsum(weight[order][::-1])[::-1]
    levels = left / share
    open_ = np.flatnonzero(ratio[order] > levels)
    level = levels[open_[0]] if len(open_) else np.inf
    return np.minimum(cap, level * weight)


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _draw(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _shares(sized: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row a source: skey, source_size, target, whole, rest, edge, edge_before.

    ``rest`` words come from one more pass in the order of the draw; ``edge`` is
    the slice in which they are reached, ``edge_before`` the words before it.
    """
    spark = sized.sparkSession
    slices = cut(sized.groupBy("skey", "source", "slice").agg(F.sum("size").alias("slice_size")))
    sources = slices.groupBy("skey", "source").agg(F.sum("slice_size").alias("n"))
    rows = sources.limit(DRIVER_SOURCES + 1).collect()
    many = len(rows) > DRIVER_SOURCES
    if many:
        shares = _filled(sources, weights, max_epochs)
    else:
        rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        targets = water_fill([r["n"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], sum(r["n"] for r in rows), max_epochs)
        shares = spark.createDataFrame([(r["skey"], int(r["n"]), float(target)) for r, target in zip(rows, targets, strict=True)], "skey string, source_size long, target double")
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    shares = shares.withColumn("words", words).withColumn("whole", whole.cast("long")).withColumn("rest", (F.col("words") - F.col("whole") * F.col("source_size")).cast("long"))
    shares = shares.withColumn("target", F.round("target", 6)).drop("words")
    along = Window.partitionBy("skey").orderBy("slice")
    edges = (
        slices.select("skey", "slice", "slice_size", (F.sum("slice_size").over(along) - F.col("slice_size")).alias("before"))
        .join(shares.select("skey", "rest"), "skey")
        .where((F.col("rest") > 0) & (F.col("before") < F.col("rest")) & (F.col("before") + F.col("slice_size") >= F.col("rest")))
        .select("skey", F.col("slice").alias("edge"), F.col("before").alias("edge_before"))
    )
    known = cut(shares.join(edges, "skey", "left"))
    return known if many or len(rows) > BROADCAST_SOURCES else F.broadcast(known)


def _filled(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``water_fill`` for any number of sources: skey, source_size, target.

    Every round clamps the sources whose share exceeds their cap and shares out what is
    left among the others, until no more are clamped.
    """
    ranked = numbered(sources, [F.col("source").isNull(), F.col("source")], "_rank")
    of_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    known = cut(ranked.select("skey", F.col("n").alias("source_size"), of_rank.alias("weight"), (F.col("n") * F.lit(float(max_epochs))).alias("cap")))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        open_ = F.col("cap") > level * F.col("weight")
        r = known.agg(F.sum((~open_).cast("long")).alias("clamped"), F.sum(F.when(~open_, F.col("cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        if r["weight"] is None or r["clamped"] == clamped:
            break
        level, clamped = (total - r["taken"]) / r["weight"], r["clamped"]
    share = F.col("cap") if r["weight"] is None else F.least("cap", F.lit(level) * F.col("weight"))
    return known.select("skey", "source_size", share.alias("target"))


def _decided(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """``sized`` with the columns of its source's share and ``extra``; only the rows of an edge slice are sorted."""
    known = sized.join(shares, "skey")
    inside = Window.partitionBy("skey").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = known.where(F.col("slice") == F.col("edge")).withColumn("reached", F.col("edge_before") + F.sum("size").over(inside))
    extra_at_edge = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("reached") + F.col("size")))
    others = known.where(F.col("edge").isNull() | (F.col("slice") != F.col("edge")))
    extra = F.when(F.col("edge").isNotNull() & (F.col("slice") < F.col("edge")), F.col("size")).otherwise(F.lit(0))
    return others.withColumn("extra", extra.cast("long")).unionByName(at_edge.withColumn("extra", extra_at_edge.cast("long")).drop("reached"))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    draw = _draw(F.col("doc_id"), seed)
    own = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw.alias("draw"), *more)
    return own.withColumn("skey", _key(F.col("source"))).withColumn("slice", F.substring("draw", 1, SLICE_DIGITS))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, whole, extra, taken.

    ``whole`` counts full repetitions, ``extra`` the words of one further
    repetition, ``taken = whole * size + extra``. ``weights`` repeat over the
    sources in code point order, null last.
    """
    sized = cut(_sized(docs, seed))
    decided = _decided(sized, _shares(sized, weights, max_epochs))
    return decided.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def materialize(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mixed documents: every row as often as ``plan`` says, with the columns of ``docs``.

    The one document of a source that is taken in part contributes its first
    ``extra`` words, with the white space between them; a column ``n_chars``
    then holds the length of that part. Documents without words are kept as
    often as whole passes are made, and once at least. Texts are never shuffled
    but for the rows of the edge slices.
    """
    shares = _shares(cut(_sized(docs, seed)), weights, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    decided = _decided(_sized(docs, seed, row), shares)
    full = F.col("whole") + ((F.col("extra") >= F.col("size")) & ((F.col("size") > 0) | (F.col("whole") == 0))).cast("int")
    part = ((F.col("extra") > 0) & (F.col("extra") < F.col("size"))).cast("int")
    copies = decided.withColumn("all", F.explode(F.concat(F.array_repeat(F.lit(True), full.cast("int")), F.array_repeat(F.lit(False), part))))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("all"), F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("extra"), F.lit(1)).cast("int")), ""))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("all"), F.col("row.n_chars")).otherwise(F.length(text).cast("long"))
    return copies.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
