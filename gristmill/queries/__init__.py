"""Registered queries over the driver tables, each with its DuckDB statement where SQL can express it."""

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("text", "similarity", "postings", "log", "boards", "pages", "responses", "matching")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def load() -> None:
    for module in MODULES:
        import_module(f"gristmill.queries.{module}")
