"""Queries of the operators and their check SQL."""

from __future__ import annotations

from judgelake.plans.registry import Query

LLM_QUERIES: dict[str, Query] = {}
LLM_CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage, with check SQL where SQL can express it."""

    def add(fn: Query) -> Query:
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_CHECK_SQL[name] = sql
        return fn

    return add
