"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with DuckDB SQL where that can express it."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle.strip()
        return f

    return register
