"""What can go wrong, as codes that callers can switch on."""

from __future__ import annotations

# The codes.
VALIDATION_ERROR, PAYLOAD_TOO_LARGE, VERSION_NOT_FOUND, CHUNK_NOT_FOUND = "VALIDATION_ERROR", "PAYLOAD_TOO_LARGE", "VERSION_NOT_FOUND", "CHUNK_NOT_FOUND"
INDEX_UNAVAILABLE, MODEL_UNAVAILABLE, CONTRACT_VIOLATION, INTERNAL_ERROR = "INDEX_UNAVAILABLE", "MODEL_UNAVAILABLE", "CONTRACT_VIOLATION", "INTERNAL_ERROR"


class EngineError(Exception):
    """An error with a ``code``."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class QueryError(EngineError, ValueError):
    """A request that cannot be answered as it is."""


class NotFound(EngineError, LookupError):
    """A version, chunk, index or task that is not there."""
