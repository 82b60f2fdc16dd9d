"""Errors and warnings. A capability that is missing, input that is wrong, and a failing backend are told apart."""

from __future__ import annotations


class HalyardError(Exception):
    """Base of all errors of this library."""


class CapabilityError(HalyardError):
    """A valid request that this engine does not serve."""


class UnsupportedParameter(CapabilityError, ValueError):
    """A parameter value outside what is served."""


class UnsupportedInput(CapabilityError, ValueError):
    """Input of a kind that is not served."""


class SparseInput(UnsupportedInput, TypeError):
    """Sparse vectors where dense ones are needed."""


class UnsupportedState(CapabilityError, ValueError):
    """A fitted estimator in a state that the request does not fit."""


class NotFitted(HalyardError, ValueError, AttributeError):
    """An operation that needs ``fit`` first."""


class DeviceError(HalyardError, RuntimeError):
    """No Spark session to run on."""


class BackendError(HalyardError, RuntimeError):
    """Spark failed while running a request."""


#: The name under which callers may catch both missing parameters and missing inputs.
NotSupported = CapabilityError


class HalyardWarning(UserWarning):
    """Base of all warnings of this library."""


class ConvergenceWarning(HalyardWarning):
    """An iterative fit ended before its stopping rule was met."""


class FallbackWarning(HalyardWarning):
    """A request was served by another path than asked for."""


class DataConversionWarning(HalyardWarning):
    """Input was converted on the way in."""
