"""Registration of queries next to the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = (
    "ingest",
    "columns",
    "labels",
    "cohorts",
    "metrics",
    "graph",
    "features",
    "models",
    "digest",
    "streams",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is left out where SQL cannot express the operator."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"impactlens.catalog.{module}")
