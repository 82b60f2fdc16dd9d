"""Readers and writers of tables of vectors, in any format that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.vectors import vector


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table; columns and predicates are pushed to the scan where the format allows."""
    return spark.read.format(kind).options(**options).load(path)


def vectors(df: DataFrame, id_col: str, features: str | list[str], label: str | None = None, weight: str | None = None) -> DataFrame:
    """id, features, and label and weight where named."""
    columns = [F.col(id_col).alias("id"), vector(df, features).alias("features")]
    return df.select(*columns, *([F.col(label).alias("label")] if label else []), *([F.col(weight).cast("double").alias("weight")] if weight else []))


def numbered(df: DataFrame, order: list[str | Column], name: str = "id") -> DataFrame:
    """``df`` with a number from 0 in the order of columns, for tables without an id.

    Rows are sorted by range over all tasks and numbered within their task, after the
    counts of the tasks before; no task sees all rows.
    """
    placed = df.sort(*order).withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.persist()
    counts = {r[0]: r[1] for r in placed.groupBy("_task").count().collect()}
    before, total = {}, 0
    for task in sorted(counts):
        before[task], total = total, total + counts[task]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    within = F.col("_at") - F.shiftleft(F.col("_task").cast("long"), 33)
    return placed.withColumn(name, offsets[F.col("_task").cast("long")] + within).drop("_task", "_at")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    df.write.format(kind).mode(mode).options(**options).save(path)


def edges_to_lists(edges: DataFrame, source: str = "src", target: str = "dst", value: str = "value") -> DataFrame:
    """A graph's edges as one row for each source: sorted targets and their values."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(target).alias("dst"), F.col(value).alias("value"))))
    return edges.groupBy(source).agg(pairs.alias("edges")).select(source, F.transform("edges", lambda e: e["dst"]).alias("targets"), F.transform("edges", lambda e: e["value"]).alias("values"))
