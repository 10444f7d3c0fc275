"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result over the raw tables."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            # the same tie shift as in round_doubles
            ORACLES[name] = " ".join(sql.split()).replace(", 6) + 0.0", " + 1e-9, 6) + 0.0")
        return fn

    return wrap
