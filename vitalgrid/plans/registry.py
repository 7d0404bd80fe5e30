"""Named queries over a table folder, each with its DuckDB text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.plans.views import select

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = select(sql)
        return function

    return register


def load_all() -> None:
    from vitalgrid.plans import batch, evaluation, metrics, model, radiology, scalars, streams, triage  # noqa: F401
