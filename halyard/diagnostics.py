"""What ran where: a bounded record of the physical path that each operation took."""

from __future__ import annotations

import threading
import warnings
from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from halyard.config import get_config
from halyard.errors import DeviceError, FallbackWarning

KEPT = 512


@dataclass(frozen=True)
class BackendEvent:
    """One operation of an estimator."""

    estimator: str
    operation: str
    backend: str
    reason: str = ""
    detail: str = ""
    shape: tuple[int, ...] = ()
    fallback: bool = False
    extra: dict = field(default_factory=dict)


_events: deque[BackendEvent] = deque(maxlen=KEPT)
_warned: set[tuple[str, str]] = set()
_lock = threading.Lock()


def record_event(event: BackendEvent) -> None:
    """Keeps an event; a fallback warns once for each estimator and reason if the settings ask for it."""
    how = get_config().diagnostics
    if how == "off":
        return
    with _lock:
        _events.append(event)
        first = (event.estimator, event.reason) not in _warned
        if event.fallback and how == "warn" and first:
            _warned.add((event.estimator, event.reason))
    if event.fallback and how == "warn" and first:
        warnings.warn(f"{event.estimator}.{event.operation} ran on {event.backend}: {event.reason}", FallbackWarning, stacklevel=3)


def get_backend_diagnostics() -> list[BackendEvent]:
    with _lock:
        return list(_events)


def get_last_backend_event() -> BackendEvent | None:
    with _lock:
        return _events[-1] if _events else None


def clear_backend_diagnostics() -> None:
    with _lock:
        _events.clear()
        _warned.clear()


def diagnostics_summary() -> dict[str, int]:
    """How often each ``estimator.operation -> backend`` occurred."""
    return dict(Counter(f"{e.estimator}.{e.operation} -> {e.backend}" for e in get_backend_diagnostics()))


def diagnostics_df(spark: SparkSession) -> DataFrame:
    """The record as a table."""
    rows = [{k: str(v) if k in ("shape", "extra") else v for k, v in asdict(e).items()} for e in get_backend_diagnostics()]
    return spark.createDataFrame(rows, "estimator string, operation string, backend string, reason string, detail string, shape string, fallback boolean, extra string")


def device_info() -> dict[str, object]:
    """Where work runs: the active Spark session."""
    spark = resolve_device()
    return {"engine": "spark", "version": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism}


def gpu_available() -> bool:
    """Whether executors of the active session were given accelerators."""
    spark = SparkSession.getActiveSession()
    return spark is not None and int(spark.sparkContext.getConf().get("spark.executor.resource.gpu.amount", "0")) > 0


@contextmanager
def use_device(spark: SparkSession) -> Iterator[SparkSession]:
    """Runs a block with ``spark`` as the active session."""
    before, session = SparkSession.getActiveSession(), spark._jvm.SparkSession
    session.setActiveSession(spark._jsparkSession)
    try:
        yield spark
    finally:
        if before is not None:
            session.setActiveSession(before._jsparkSession)


def resolve_device() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise DeviceError("there is no active Spark session")
    return spark
