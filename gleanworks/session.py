"""Session construction and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Local defaults only: on a cluster the submitting side sets master, memory and
# shuffle width, and the settings below that matter for results are the last block.
_LOCAL = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.shuffle.partitions": "8",
}
_ALWAYS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def local_session(app: str = "gleanworks", cpus: int | str | None = None, **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**_LOCAL, **_ALWAYS, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_code(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a fresh local one only under a local master."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so that a lost executor cannot force a replay of all rounds.

    What an execution has shuffled goes with its end: the checkpoint stands for it, and loops of many small rounds would else fill the disks
    until the driver happens to collect its garbage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as compressed Parquet in the shared folder for as long as the block lasts."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(folder)
        yield spark.read.parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python gets at most ``rows`` rows at a time in what is executed inside the block: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_gleanworks_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-code-", dir="/tmp"), "gleanworks.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._gleanworks_shipped = True


def one_row(*tables: DataFrame) -> DataFrame:
    """Put single-row tables side by side: scalar subqueries, no join."""
    spark = tables[0].sparkSession
    parts = [t.select(F.struct("*")).scalar().alias(f"_t{i}") for i, t in enumerate(tables)]
    return spark.range(1, numPartitions=1).select(*parts).select(*[f"_t{i}.*" for i in range(len(tables))])


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row.

    A plain projection may be merged into every later use of the column, which would repeat text scans; a generator
    over a one-element array is not merged and costs nothing but a copy of the row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for work that is heavy per row when the input has fewer partitions than there are cores.

    Large inputs have more partitions than that and pass through without a shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
