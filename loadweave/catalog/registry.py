"""Named queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked by tests on small fixtures."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round double columns (all, or the named ones) for comparison."""
    names = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names}) if names else df


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero removes a negative zero."""
    return f"round({expr}, {digits}) + 0.0"
