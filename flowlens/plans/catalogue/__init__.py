"""Named queries over the test tables, each with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load() -> None:
    """Import every module that registers queries."""
    from flowlens.plans.catalogue import (  # noqa: F401
        decoding,
        detecting,
        features,
        learning,
        live,
        preparation,
        storage,
        streams,
        traffic,
    )
