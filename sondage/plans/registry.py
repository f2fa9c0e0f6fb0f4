"""Registered queries and their SQL twins, outside the training-data package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("cube_queries", "table_queries", "table_match_queries", "evaluation_queries", "deck_queries", "text_queries", "search_queries", "metric_queries", "conversation_queries", "lifecycle_queries", "scope_queries", "verification_queries", "selection_queries", "mention_queries", "coverage_queries", "answer_queries", "planning_queries")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
