"""Errors as users of a service see them: a status code, a message and headers."""

from __future__ import annotations

from dataclasses import dataclass, field


class RequestError(Exception):
    """An error of a request with a status code of its own."""

    def __init__(self, message: str, status_code: int = 400, headers: dict[str, str] | None = None):
        super().__init__(message)
        self.status_code, self.headers = status_code, headers or {}


@dataclass(frozen=True)
class Answer:
    status_code: int
    message: str
    headers: dict[str, str] = field(default_factory=dict)


#: Messages that tell nothing of a cause.
INVALID, UNEXPECTED = "Request validation failed.", "An unexpected server error occurred."


def answer_of(error: BaseException) -> Answer:
    """Errors with a status code keep it, with their message and headers; a wrong value is 422; anything else is 500 and tells nothing of its cause."""
    code = getattr(error, "status_code", None)
    if isinstance(code, int):
        text = error.args[0] if error.args and isinstance(error.args[0], str) else str(error)
        return Answer(code, text, dict(getattr(error, "headers", None) or {}))
    if isinstance(error, ValueError):
        return Answer(422, INVALID)
    return Answer(500, UNEXPECTED)
