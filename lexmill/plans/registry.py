"""One place that knows every registered query."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.session import spread

TEXT_TABLES = ("documents", "pages", "conversations")
QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}

MODULES = (
    "lexical",
    "ranking",
    "telemetry",
    "access",
    "vectors",
    "hygiene",
    "chunks",
    "datasets",
    "scoring",
    "dialogues",
    "storage",
    "streams",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say it, the equivalent statement."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__module_name__ = fn.__module__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lexmill.plans.{module}")


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
