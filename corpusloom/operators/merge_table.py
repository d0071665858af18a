"""A keyed table on shared storage that is changed in batches, bucket by bucket.

Rows lie in ``data/version=V/bucket=B``, by a hash of their key. A batch rewrites only the
buckets that its keys fall in, under a new version, and then commits by a manifest that tells
for every bucket which version holds it (one small row a bucket). Readers follow the newest
manifest, so a batch is seen whole or not at all; one that failed leaves files that no
manifest names, which its rerun overwrites. A batch id that a manifest names is done: giving
it again changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_MANIFEST = "bucket int, held int, batch string, n_buckets int, version int"


def _manifests(spark: SparkSession, path: str) -> list:
    """The newest manifest's rows, at most one a bucket."""
    stored = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest).collect()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def batches(spark: SparkSession, path: str) -> set[str]:
    """The ids of all batches that were committed."""
    if not _exists(spark, f"{path}/manifest"):
        return set()
    return {r.batch for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("batch").distinct().collect()}


def _stored(spark: SparkSession, path: str, schema: str, manifest: list, buckets: list[int] | None = None) -> DataFrame:
    held: dict[int, list[int]] = {}
    for r in manifest:
        if r.held is not None and (buckets is None or r.bucket in buckets):
            held.setdefault(r.held, []).append(r.bucket)
    if not held:
        return spark.createDataFrame([], schema)
    parts = [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in sorted(held.items())]
    return spark.read.schema(f"{schema}, version int, bucket int").parquet(f"{path}/data").where(reduce(lambda a, b: a | b, parts)).drop("version", "bucket")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows; ``schema`` are its columns as DDL."""
    return _stored(spark, path, schema, _manifests(spark, path))


def merge(rows: DataFrame, path: str, key: str, batch: str, delete: DataFrame | None = None, n_buckets: int = BUCKETS) -> int:
    """Delete the keys of ``delete``, then put ``rows`` in by ``key``; returns the buckets rewritten.

    Of rows with one key in a batch the greatest by its other columns is kept. Rows without
    a key are left out. The first batch makes the table and fixes its number of buckets.
    """
    spark = rows.sparkSession
    manifest, version = [], 0
    if _exists(spark, f"{path}/manifest"):
        if batch in batches(spark, path):
            return 0
        manifest = _manifests(spark, path)
        version, n_buckets = manifest[0].version + 1, manifest[0].n_buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int").alias("bucket")
    others = [c for c in rows.columns if c != key]
    types = dict(rows.dtypes)
    # the key keeps its place; one row a key
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others) if others else F.struct(F.lit(0))).alias("_row"))
    new = found.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    keys = new.select(key)
    if delete is not None:
        keys = keys.union(delete.where(F.col(key).isNotNull()).select(F.col(key).cast(types[key]))).distinct()
    touched = sorted(r.bucket for r in keys.select(bucket).distinct().collect())  # at most n_buckets
    if touched:
        schema = ", ".join(f"`{c}` {types[c]}" for c in rows.columns)
        kept = _stored(spark, path, schema, manifest, touched).join(keys, key, "left_anti")
        out = kept.unionByName(new).select(*rows.columns, bucket)
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    held = {r.bucket: r.held for r in manifest} | {b: version for b in touched}
    told = [(b, held.get(b), batch, n_buckets) for b in range(n_buckets)]
    spark.createDataFrame(told, "bucket int, held int, batch string, n_buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return len(touched)
