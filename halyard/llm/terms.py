"""Hashed terms, and bounded samples for fitting models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are no part of a term at its ends.
EDGES = ".,;:!?()[]{}\"'|-_*#%&$@~^<>/\\=+"


class Memo(dict):
    """A function of a word, remembered for up to ``limit`` words that aren't long; only speed depends on it."""

    def __init__(self, function: Callable[[str], Any], limit: int = 150_000) -> None:
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, word: str) -> Any:
        value = self.function(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def bucket(term: str, bits: int) -> int:
    """The bucket of a term; the same in every process."""
    return xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass")) >> (32 - bits)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 modulo 3. Null ids count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def sampled(rows: DataFrame, key: Column, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, the same ones each time, chosen by a hash of ``key``; all, if there are fewer."""
    n = rows.count()
    if n <= bound:
        return rows
    steps = 1 << 30
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(steps)) < int(steps * bound / n))
