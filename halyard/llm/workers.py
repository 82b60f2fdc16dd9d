"""Memory of Python workers, which outlive their tasks and share an executor's memory with others."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch where rows hold whole texts.
TEXTS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sends whole texts to Python some ``TEXTS`` at a time, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS:
        spark.conf.set(key, str(TEXTS))


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt to all cores if it comes in fewer partitions (a small table in one file)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives freed memory back to the system when its task ends."""

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            _trim()

    return run
