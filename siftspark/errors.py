"""Typed errors. Every public failure carries a numeric ``code``."""

from __future__ import annotations

# Error codes of the public API.
BAD_REQUEST = 40001
BAD_DIM = 40002
BAD_FILTER = 40003
UNAUTHORIZED = 40100
NOT_FOUND = 40400
CONFLICT = 40900
TOO_LARGE = 41300
INTERNAL = 50000
PROVIDER = 50200


class EngineError(Exception):
    """An error with a stable ``code`` and a message."""

    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message


def wrap(code: int, message: str, cause: BaseException) -> EngineError:
    """An EngineError whose cause is kept."""
    e = EngineError(code, f"{message}: {cause}")
    e.__cause__ = cause
    return e


def is_code(e: BaseException, code: int) -> bool:
    return isinstance(e, EngineError) and e.code == code
