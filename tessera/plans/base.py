"""Registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name; ``sql`` is the same query for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: rows of a task that sorts or groups; fixed value
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame, most: int = TASK_ROWS) -> int:
    """How many tasks the rows of a stored table need so that none has many more than ``most``; the count comes from the files' footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
