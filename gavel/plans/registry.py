"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL when there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def with_views(final: str, views: dict[str, str]) -> str:
    """Prefix a SELECT with the common table expressions it uses, in order."""

    def uses(text: str) -> set[str]:
        return {name for name in views if re.search(rf"\b{name}\b", text)}

    needed, todo = set(), uses(final)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= uses(views[name]) - needed - {name}
    parts = [f"{name} AS ({body})" for name, body in views.items() if name in needed]
    return f"WITH {', '.join(parts)} {final}" if parts else final
