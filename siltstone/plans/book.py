"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        def keep(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
