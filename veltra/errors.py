"""The one error type of the engine. Callers act on the code; the text is for people."""

from __future__ import annotations

#: All error codes.
CODES = ("PARSE", "BIND", "TYPE", "NUMERIC", "CSV", "CATALOG", "RESOURCE", "UNSUPPORTED", "IO", "PROTOCOL", "CLI", "INTERNAL")


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        assert code in CODES
        super().__init__(message)
        self.code = code
        self.message = message

    def as_dict(self) -> dict:
        return {"ok": False, "error": {"code": self.code, "message": self.message}}
