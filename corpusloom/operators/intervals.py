"""Points inside ranges, by an equi-join on bins of powers of two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import tasks_for


def innermost(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, take: list[str]) -> DataFrame:
    """``points`` with ``start``, ``end`` and the columns ``take`` of the range around them.

    Of several ranges (bounds included) that with the largest start counts, then that with
    the smallest end, then the greatest by ``take``. Points outside every range, or with a
    null in ``by`` or ``at``, keep nulls; ranges with a null bound or that end before they
    start hold nothing.

    A range lies in at most two bins as wide as itself, rounded up to a power of two, however
    long it is; a point looks into one bin for each width there is. A bin of one file holds
    the ranges that nest there, so the work is linear in both sides, and the rows of one
    file are spread over its bins. Points of one place are looked up once.
    """
    length = F.col(end) - F.col(start) + 1
    sound = ranges.where(F.col(end) >= F.col(start)).select(*by, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.when(length <= 1, 0).otherwise(F.length(F.bin((length - 1).cast("long")))).alias("_width"), F.struct(*take).alias("_take"))
    widths = sorted(r[0] for r in sound.select("_width").distinct().collect())  # at most 64
    bins = sound.withColumn("_bin", F.explode(F.expr("array_distinct(array(shiftright(_s, _width), shiftright(_e, _width)))")))
    tasks = tasks_for(points)
    # points and what is found for them share one deal
    located = points.withColumn("_at", F.col(at).cast("long")).repartition(tasks, *by, "_at")
    places = located.select(*by, "_at").dropna().distinct()
    probes = places.withColumn("_width", F.explode(F.lit(widths).cast("array<int>"))).withColumn("_bin", F.expr("shiftright(_at, _width)"))
    met = probes.repartition(tasks * max(1, len(widths)), *by, "_width", "_bin").join(bins, [*by, "_width", "_bin"]).where("_at between _s and _e")
    best = met.repartition(tasks, *by, "_at").groupBy(*by, "_at").agg(F.max(F.struct("_s", (-F.col("_e")).alias("_less"), "_take")).alias("_in"))
    found = best.select(*by, "_at", F.col("_in._s").alias(start), (-F.col("_in._less")).alias(end), *[F.col(f"_in._take.{c}").alias(c) for c in take])
    rest = [c for c in points.columns if c not in (*by, at)]
    return located.join(found, [*by, "_at"], "left").select(*by, at, *rest, start, end, *take)
