"""Errors with a code, as callers of the engine see them."""

from __future__ import annotations


class EngineError(Exception):
    """code: invalid_argument, not_found, conflict, resource_exhausted, unavailable or permission_denied; status: the HTTP number that goes with it."""

    STATUS = {"invalid_argument": 400, "permission_denied": 403, "not_found": 404, "conflict": 409, "resource_exhausted": 429, "unavailable": 503}

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message

    @property
    def status(self) -> int:
        return self.STATUS[self.code]


def invalid(message: str) -> EngineError:
    return EngineError("invalid_argument", message)


def not_found(message: str) -> EngineError:
    return EngineError("not_found", message)


def conflict(message: str) -> EngineError:
    return EngineError("conflict", message)


def exhausted(message: str) -> EngineError:
    return EngineError("resource_exhausted", message)
