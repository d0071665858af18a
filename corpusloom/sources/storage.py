"""Shared storage: tables by name, lineage cuts, and small writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, shared by all executors; only a
    local session may use a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise on the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made within go when their action ends, not when the driver
    happens to collect its garbage. A later action on the same query shuffles once more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


#: Rows of a task that sorts them, about.
TASK_ROWS = 1 << 18


def tasks_for(df: DataFrame) -> int:
    """How many tasks the rows of ``df`` call for."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` hashed by the columns ``by`` into as many tasks as its rows call for, so that the
    memory of a task that sorts its rows does not grow with the table."""
    return df.repartition(tasks_for(df), *by)


def append_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Append rows to a table laid out by ``by``, as a vector store's upsert batches."""
    df.write.mode("append").partitionBy(by).parquet(path)


def create_if_missing(spark: SparkSession, name: str, ddl: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")
