"""The list of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(*names: str, sql: str | None = None, recursive: bool = False) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register f(*fixtures) under its own name; fixtures are those named, in order. sql starts after their WITH."""

    def register(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[fixtures.load(spark, sf_dir, n) for n in names])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = f"{fixtures.duck(*names, recursive=recursive)} {sql}" if names else sql
        return run

    return register


def on_tables(*tables: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """As query(), for f(*tables) on tables as they are."""

    def register(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return register
