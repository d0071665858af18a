"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, scratch_path, scratch_scope


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b) of longs.

    Alternates large-star and small-star steps until the edges form stars around the
    smallest node of each component: O(log^2 n) rounds, each one aggregation and one join
    a step. A round is written to shared storage and deleted once the next one is. Hubs are
    aggregated by a minimum, which combines before the shuffle, and joined on sides that
    adaptive execution splits. Self-loops, repeated edges and nulls are ignored; no edges
    give no rows.
    """
    with scratch_scope(edges.sparkSession):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    spark, path = edges.sparkSession, ""

    def written(edges: DataFrame) -> DataFrame:
        nonlocal path
        before, path = path, scratch_path(spark, "edges")
        edges.write.parquet(path)
        if before:
            discard(spark, before)
        return spark.read.schema(edges.schema).parquet(path)

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low.select("a", "m")).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return cut(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()))
