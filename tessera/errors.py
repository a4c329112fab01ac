"""Errors by status, as collections report them."""

from __future__ import annotations


class EngineError(ValueError):
    status = "UNKNOWN"


class InvalidArgument(EngineError):
    status = "INVALID_ARGUMENT"


class NotFound(EngineError):
    status = "NOT_FOUND"


class AlreadyExists(EngineError):
    status = "ALREADY_EXISTS"


class NotSupported(EngineError):
    status = "NOT_SUPPORTED"


class PermissionDenied(EngineError):
    status = "PERMISSION_DENIED"


class FailedPrecondition(EngineError):
    status = "FAILED_PRECONDITION"
