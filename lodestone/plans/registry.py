"""Named queries over the driver tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


_BUILT: dict[tuple, object] = {}


def built_once(spark: SparkSession, *key, build: Callable[[], object]) -> object:
    """Index tables are built once per application and input folder, as a search service would."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _BUILT:
        _BUILT[full] = build()
    return _BUILT[full]
