"""The core's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import course, documents, integrity, knowledge, methods

_MODULES = [integrity, knowledge, course, documents, methods]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable(spark, folder)."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
