"""Queries of the engine by name, with the DuckDB text that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ("link_queries", "interval_queries", "ordering_queries", "size_queries", "graph_queries")


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in _MODULES:
        found |= import_module(f"chromaloom.plans.{name}").REGISTRY
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: check for name, (_, check) in _all().items() if check is not None}
