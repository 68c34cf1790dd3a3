"""Refusals with the status that a request gets."""

from __future__ import annotations


class RequestError(Exception):
    """A request that can't be answered; ``position`` is where in its text, if known."""

    status = 400

    def __init__(self, message: str, position: int | None = None) -> None:
        super().__init__(message)
        self.message, self.position = message, position

    def envelope(self, header: dict | None = None) -> dict:
        body = {"msg": self.message, "code": self.status}
        if self.position is not None:
            body["pos"] = self.position
        out = {} if header is None else {"responseHeader": header | {"status": self.status}}
        return out | {"error": body}


class InternalError(RequestError):
    """Bad regular expressions and failures of the engine itself."""

    status = 500


class UnsupportedFormat(RequestError):
    """Documents from which no text can be drawn here."""

    status = 415
