"""Every query of the reference's operators, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that has the same rows."""

    def put(call):
        _QUERIES[call.__name__] = call
        if sql:
            _SQL[call.__name__] = sql
        return call

    return put


def _load() -> None:
    from . import factor_queries, market_queries, pit_queries, run_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["e1_sma3_walk_forward"](spark, sf_dir)
