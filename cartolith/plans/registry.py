"""All queries of the core with their SQL counterparts, collected from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("history_queries", "graph_queries", "incident_queries", "quality_queries", "retrieval_queries", "source_queries", "search_queries", "structure_queries", "scan_queries")


def _all() -> list:
    return [import_module(f"cartolith.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _all() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _all() for name, sql in module.SQL.items()}
