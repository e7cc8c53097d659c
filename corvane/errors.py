"""Errors by what a caller can do about them."""

from __future__ import annotations


class CorvaneError(Exception):
    """Base class; ``status`` is the HTTP status that an API would give."""

    status = 500


class ConfigurationError(CorvaneError):
    """A setting or path is wrong."""

    status = 400


class DataFormatError(CorvaneError):
    """A stored or supplied record is not of the expected form."""

    status = 400


class ProviderError(CorvaneError):
    """A model provider failed."""

    status = 503


class StoreError(CorvaneError):
    """The index store failed; ``code`` names the reason."""

    status = 503

    def __init__(self, message: str, code: str = "operation_failed"):
        super().__init__(message)
        self.code = code
