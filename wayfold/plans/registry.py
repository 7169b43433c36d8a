"""Registration of named queries with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """The queries of a module."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
