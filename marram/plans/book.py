"""A small book of queries: name, function, SQL twin."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable, sql: str | None = None) -> None:
        self.queries[name] = build
        if sql is not None:
            self.oracles[name] = sql
