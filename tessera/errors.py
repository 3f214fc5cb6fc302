"""The one error class of the library, told apart by its code."""

from __future__ import annotations

from typing import Any

CODES = (
    "VALIDATION",
    "NOT_FOUND",
    "ALREADY_EXISTS",
    "SCHEMA_VIOLATION",
    "CONFLICT",
    "INVALID_QUERY",
    "INVALID_URI",
    "UNAVAILABLE",
    "UNSUPPORTED",
)


class TesseraError(Exception):
    """An error with a code, and where it applies a uri, an action and field-level issues."""

    def __init__(self, code: str, message: str, *, uri: str | None = None, action: str | None = None, issues: list[dict[str, str]] | None = None):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(message)
        self.code, self.message, self.uri, self.action, self.issues = code, message, uri, action, issues

    def to_json(self) -> dict[str, Any]:
        found = {"code": self.code, "message": self.message, "uri": self.uri, "action": self.action, "issues": self.issues}
        return {k: v for k, v in found.items() if v is not None}
