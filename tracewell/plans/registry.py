"""All queries outside the corpus operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import column_queries, graph_queries, project_queries, sql_queries

_PARTS = (graph_queries, column_queries, sql_queries, project_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.ORACLES.items()}
