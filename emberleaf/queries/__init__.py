"""Registered queries: each applies operators of the engine to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Collects queries of one module with their DuckDB SQL, where SQL can say them."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.functions[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(words) -> str:
    """A DuckDB list literal of strings."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
