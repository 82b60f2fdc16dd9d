"""A corpus from raw documents: quality, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import jaccard, linededup, mixing, quality, queries, simhash
from halyard.llm.workers import small_batches
from halyard.session import checkpoint_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rates 0.5 or better; the others go."""
    small_batches(spark)
    return quality.keep_good(docs, threshold=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of which an equal or nearly equal one came before."""
    small_batches(spark)
    return linededup.deduplicate(docs, max_edits=2, per_edit=16)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: 4 bits of SimHash, or 0.8 of all five-word shingles."""
    small_batches(spark)
    return simhash.deduplicate(docs, width=4, threshold=4, more=jaccard.links(docs, words=5, similarity=0.8, width=4))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.materialize(docs, weights=(5, 2, 1), max_epochs=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    small_batches(spark)
    return queries.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: EM, edit distances, XXH64 majorities and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage keeps is written to the shared checkpoint folder, and goes as soon as
    the next stage is written; what the last one reads stays as long as that folder.
    """
    jvm = spark.sparkContext._jvm
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{jvm.java.util.UUID.randomUUID()}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                old = jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
