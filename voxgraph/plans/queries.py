"""Queries over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import network, records, scores, skewed, texts

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (network, texts, scores, records, skewed)


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
