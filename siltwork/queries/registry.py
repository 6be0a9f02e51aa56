"""Queries with their SQL, by the name of their function."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Registers a query under its name, with its SQL."""

        def keep(f):
            self._queries[f.__name__] = f
            if sql:
                self._sql[f.__name__] = sql
            return f

        return keep

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
