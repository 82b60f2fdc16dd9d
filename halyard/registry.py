"""Names under which estimators are found, and their registration as stand-ins for Spark ML classes.

``patch`` rebinds names in a module (``pyspark.ml`` submodules by default) to the
estimators of this library and ``unpatch`` restores exactly what was there; both may
be called any number of times.
"""

from __future__ import annotations

import importlib
import threading
from dataclasses import dataclass
from types import ModuleType

from halyard.errors import UnsupportedParameter


@dataclass(frozen=True)
class Spec:
    """Where an estimator lives, and the module in which it may stand in for another."""

    name: str
    module: str
    home: str

    def load(self) -> type:
        return getattr(importlib.import_module(self.module), self.name)


ESTIMATORS = {
    s.name: s
    for s in (
        Spec("NearestNeighbors", "halyard.operators.neighbors", "pyspark.ml.feature"),
        Spec("KNeighborsClassifier", "halyard.operators.neighbors", "pyspark.ml.classification"),
        Spec("KNeighborsRegressor", "halyard.operators.neighbors", "pyspark.ml.regression"),
        Spec("LogisticRegression", "halyard.operators.linear", "pyspark.ml.classification"),
        Spec("PCA", "halyard.operators.decomposition", "pyspark.ml.feature"),
        Spec("SVC", "halyard.operators.svm", "pyspark.ml.classification"),
        Spec("KMeans", "halyard.operators.kmeans", "pyspark.ml.clustering"),
        Spec("EMeans", "halyard.operators.emeans", "pyspark.ml.clustering"),
        Spec("OMeans", "halyard.operators.emeans", "pyspark.ml.clustering"),
    )
}
#: Names that are registered unless others are asked for.
DEFAULT = ("NearestNeighbors", "KNeighborsClassifier", "KNeighborsRegressor", "LogisticRegression", "PCA", "SVC")
_ABSENT = object()
_before: dict[tuple[str, str], object] = {}
_lock = threading.RLock()


def resolve_names(names: str | list[str] | None = None) -> list[str]:
    """Checked names, without repeats."""
    wanted = list(DEFAULT) if names is None else [names] if isinstance(names, str) else list(names)
    if unknown := [n for n in wanted if n not in ESTIMATORS]:
        raise UnsupportedParameter(f"unknown estimators: {', '.join(unknown)}; known are {', '.join(ESTIMATORS)}")
    return list(dict.fromkeys(wanted))


def short_name(name: str) -> str:
    """The estimator of a full name such as ``pyspark.ml.feature.PCA``."""
    return resolve_names(name.rpartition(".")[2])[0]


def patch_names() -> list[str]:
    """Full names that ``patch`` rebinds unless others are asked for."""
    return [f"{ESTIMATORS[n].home}.{n}" for n in DEFAULT]


def load(name: str) -> type:
    """The estimator of a name."""
    return ESTIMATORS[resolve_names(name)[0]].load()


def patch(names: str | list[str] | None = None, module: ModuleType | None = None) -> list[str]:
    """Rebinds names to this library's estimators; returns those that were not yet."""
    done = []
    with _lock:
        for name in resolve_names(names):
            spec = ESTIMATORS[name]
            home = module or importlib.import_module(spec.home)
            own, key = spec.load(), (home.__name__, name)
            if getattr(home, name, _ABSENT) is own:
                continue
            _before[key] = getattr(home, name, _ABSENT)
            setattr(home, name, own)
            done.append(name)
    return done


def unpatch(names: str | list[str] | None = None) -> list[str]:
    """Restores what stood under the names."""
    wanted = set(resolve_names(names) if names is not None else ESTIMATORS)
    done = []
    with _lock:
        for (home, name), old in list(_before.items()):
            if name not in wanted:
                continue
            module = importlib.import_module(home)
            if getattr(module, name, _ABSENT) is ESTIMATORS[name].load():
                if old is _ABSENT:
                    delattr(module, name)
                else:
                    setattr(module, name, old)
            del _before[home, name]
            done.append(name)
    return done


def is_patched(name: str) -> bool:
    with _lock:
        return any(n == resolve_names(name)[0] for _, n in _before)


def patched_estimators() -> list[str]:
    with _lock:
        return sorted({n for _, n in _before})
