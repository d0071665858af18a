"""Helpers shared by the corpus operators: shared storage, lineage cuts, parallelism."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local session, where every executor is this process, may fall back to
    a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        at = sc.getCheckpointDir()
        if not at:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="corpusloom-")
            sc.setCheckpointDir(at)
            import atexit

            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage so that later steps neither recompute it
    nor depend on executors that may be lost."""
    spark = df.sparkSession
    at = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what is written to scratch paths named within; results that read
    them must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def small_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Actions within send Python workers at most so many rows at a time. A batch of long
    texts is held by the executor and by its worker, both outside of the heap."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def brief_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of queries made within go when their action ends, not when the driver
    happens to collect its garbage. A later action on the same query shuffles once more."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, with or without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet on shared storage and read it back."""
    return written(df, scratch_path(df.sparkSession, name), codec)


def written(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to ``path`` as Parquet and read it back."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(spark: SparkSession, name: str, parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of several queries, staged one after another as one table."""
    path = scratch_path(spark, name)
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, staged; what it has staged itself on the way is deleted then."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        return written(make(), path)


def inner(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called c0, c1, ... in order, and their names by the old ones,
    so that an operator's own columns clash with none; ``toDF`` gives the old names back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(reversed(df.columns), reversed(names)))


def spread(df: DataFrame) -> DataFrame:
    """Give Python-heavy maps a task for each core when the input is one small file.

    A large input already has more splits than cores and is returned unchanged.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) & 0xFFFFFFFF
