"""Connected components of a set of links, without collecting links or components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.session import cut, forget

#: Links of which minima are broadcast at most.
BROADCAST = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) -> (node, root): the smallest node of each node's component.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step
    is one partial aggregate and one equi-join, and the number of steps grows with
    the logarithm of the number of nodes. Minima of up to ``BROADCAST`` links are
    broadcast; more are checkpointed, so that both sides of the join are plain
    shuffles and adaptive execution can split the links of a hub. Loops and
    repeated links are allowed; null ends are ignored.
    """
    edges = cut(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, count = None, edges.count()
    while True:
        few, spent = 2 * count <= BROADCAST, []

        def held(found: DataFrame, spent: list[DataFrame] = spent) -> DataFrame:
            spent.append(cut(found))
            return spent[-1]

        def least(of: DataFrame, few: bool = few, held=held) -> DataFrame:
            found = of.groupBy("u").agg(F.min("v").alias("m"))
            return F.broadcast(found) if few else held(found)

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = large if few else held(large)
        ends = large.join(least(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old, edges = edges, cut(ends.select("e.*").where(F.col("u") != F.col("v")).distinct())
        for used in (old, *spent):
            forget(used)
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())
        if now == before:
            break
        before, count = now, now[0]
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of links held in memory: the nodes, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new
