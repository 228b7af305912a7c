"""Collects the queries of a module."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query
