"""Named queries over a folder of parquet tables, with equivalent SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(value: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines; minus zero becomes zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def sql_rounded(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"
