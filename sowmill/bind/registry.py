"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES = ["scalars", "tables", "texts", "classes", "joins", "reports", "ranks", "searches", "rules", "jobs"]


def query(name: str, sql: str | None = None):
    """Register a query function; without SQL the query is checked by tests alone."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"sowmill.bind.{module}")
