"""All queries of the document world and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import functions, plans, sql

PARTS = (plans, functions, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
