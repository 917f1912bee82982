"""Registered queries of the catalog operators: name -> function, and name -> DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

MODULES = ("items_queries", "statistics_queries", "search_queries", "cleaning_queries", "extraction_queries", "other_queries", "curation_queries", "record_queries", "index_queries")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the SQL."""

    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return keep


def load() -> None:
    """Import the modules that register queries."""
    for module in MODULES:
        import_module(f"vitrine.plans.{module}")
