"""Registered queries of the engine's own operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import behavior_queries, evaluation_queries, frontend_cases, source_queries

MODULES = (evaluation_queries, behavior_queries, source_queries, frontend_cases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Public functions (spark, sf_dir) of the query modules."""
    return {name: f for m in MODULES for name, f in vars(m).items() if callable(f) and getattr(f, "__module__", "") == m.__name__ and not name.startswith("_")}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
