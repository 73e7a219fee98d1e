"""Registry of runnable queries, their SQL twins and the operators they exercise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, folder)``. ``covers`` lists operator ids; ``sql`` is the same result over the same tables."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name == "documents" else df  # long texts: per-row work dominates
