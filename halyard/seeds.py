"""Seeds, and streams of random numbers derived from them that do not depend on partitions."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.config import get_config


def resolve_seed(random_state: int | np.random.RandomState | None = None) -> int:
    """A seed; without one, the configured one, or 0 where results are to be deterministic."""
    if isinstance(random_state, np.random.RandomState):
        return int(random_state.randint(2**31))
    if random_state is not None:
        if isinstance(random_state, bool) or int(random_state) != random_state:
            raise ValueError("random_state must be an integer or None")
        return int(random_state)
    config = get_config()
    if config.random_state is not None:
        return config.random_state
    return 0 if config.deterministic else int(np.random.SeedSequence().entropy % 2**31)


def derive_seed(seed: int, *names: object) -> int:
    """An independent seed for a named part of a computation."""
    text = "\x1f".join(map(str, (seed, *names)))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def numpy_generator(seed: int, *names: object) -> np.random.Generator:
    return np.random.default_rng(derive_seed(seed, *names))


def uniform(key: Column, seed: int, *names: object) -> Column:
    """A number in [0, 1) for every key, whatever the partition."""
    mixed = F.xxhash64(key, F.lit(derive_seed(seed, *names) >> 1))
    return F.pmod(mixed, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
