"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquern.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(read) -> str:
    """A new path in the shared folder, for queries that write and read again."""
    return f"{shared_folder(read('region').sparkSession)}/query-{uuid.uuid4().hex}"


def query(sql: str | None = None):
    """Register a function (read) -> DataFrame under its name; `read(name)` gives a table."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda name: table(spark, sf_dir, name))

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register
