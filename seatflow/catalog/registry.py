"""Collects the queries of a module and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return keep
