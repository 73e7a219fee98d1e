"""Helpers shared by the training-data operators: table access, words, seeded numbers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``; ``sql`` gives the same rows in DuckDB."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*cols: Column | str) -> Column:
    """A number in the open interval (0, 1) that depends on the given columns only."""
    h = F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))
    return (h.cast("double") + 0.5) / float(1 << 52)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), 0)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes.split() cuts at space and 09-0D only."""
    return text.translate(LOWER).split() if text else []


def batches(frames: Iterator[pa.RecordBatch], limit: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than ``limit`` bytes (one row may)."""
    for b in frames:
        rows = max(1, int(b.num_rows * limit / max(1, b.nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared store and read again, and its folder."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
