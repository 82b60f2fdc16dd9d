"""Settings: immutable values, local to a context (thread or task), changed by ``set_config`` or for a ``with`` block."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, fields, replace

from halyard.errors import UnsupportedParameter


@dataclass(frozen=True)
class Config:
    """What callers may choose. ``fallback_policy``: ``error`` refuses, ``warn`` and ``allow`` serve by Spark ML."""

    device: str = "auto"
    fallback_policy: str = "error"
    output_type: str = "dataframe"
    deterministic: bool = True
    random_state: int | None = None
    diagnostics: str = "record"

    def __post_init__(self) -> None:
        for name, allowed in (("device", ("auto", "cpu")), ("fallback_policy", ("error", "warn", "allow")), ("output_type", ("dataframe", "pandas")), ("diagnostics", ("record", "warn", "off"))):
            if getattr(self, name) not in allowed:
                raise UnsupportedParameter(f"{name} must be one of {', '.join(allowed)}; got {getattr(self, name)!r}")


@dataclass(frozen=True)
class Tuning:
    """Thresholds that choose a physical path; results do not depend on them."""

    broadcast_bytes: int = 64 << 20  # a side of at most this size may be broadcast
    block_bytes: int = 16 << 20  # queries broadcast at once, where the other side is larger
    unrolled_dimensions: int = 64  # up to here vector arithmetic is unrolled into generated code
    tile_values: int = 1 << 22  # distances held at once

    @classmethod
    def from_environment(cls) -> Tuning:
        """Defaults, overridden by HALYARD_<NAME>."""
        return cls(**{f.name: int(os.environ[key]) for f in fields(cls) if (key := f"HALYARD_{f.name.upper()}") in os.environ})


_config: ContextVar[Config] = ContextVar("halyard_config", default=Config())  # noqa: B039
_tuning: ContextVar[Tuning | None] = ContextVar("halyard_tuning", default=None)


def get_config() -> Config:
    return _config.get()


def set_config(**values) -> Config:
    _config.set(replace(_config.get(), **values))
    return _config.get()


def reset_config() -> None:
    _config.set(Config())


@contextmanager
def config_context(**values) -> Iterator[Config]:
    token = _config.set(replace(_config.get(), **values))
    try:
        yield _config.get()
    finally:
        _config.reset(token)


def get_tuning() -> Tuning:
    return _tuning.get() or Tuning.from_environment()


@contextmanager
def tuning_context(**values) -> Iterator[Tuning]:
    token = _tuning.set(replace(get_tuning(), **values))
    try:
        yield get_tuning()
    finally:
        _tuning.reset(token)
