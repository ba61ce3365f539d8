"""Errors with the codes that queries are rejected with."""

from __future__ import annotations


class QueryError(Exception):
    """A query that can't be parsed, bound or run; ``code`` names the reason."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
