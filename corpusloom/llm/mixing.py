"""Mixing sources to target weights by Poisson replication.

A source of mass m (characters) whose target weight is w gets the mean repetition rate
``scale * w * M / m``, M being the mass of all rows, so that its expected mass afterwards
is ``scale * w * M``. Each row inverts the Poisson distribution of its source's rate at a
keyed hash of its doc_id, appears as often as that says, and all copies are shuffled
globally by a second hash. Counts depend on the row and the rates alone, so a rerun or a
lost executor changes nothing.

Up to ``LARGE_RATE`` the inverse is read off the cumulative distribution, one table a
source; above it, it comes from the normal quantile by the asymptotic expansion of the
Poisson quantile to the third order, whose error there is far below one count, in constant
time and space for any rate. Counts are longs. A row's copies are made in pieces of
``PIECE``, which are dealt to tasks before they are spelled out, so a source of few rows
and a huge rate neither fills one task nor one array.

Rows without doc_id are hashed by their text; rows with the same doc_id get the same
count. A null source is a source of its own. A null or empty text has mass 1, so that a
source of empty texts still has a rate; a very long one counts with all its characters.
Sources without a weight get none; without any weights all sources weigh the same. Copies
whose order keys tie follow each other in any order. An empty table gives no rows. Input
columns may have any names; one named like an output column is replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, inner

#: What an unseen source name is called inside, as nulls do not join.
_NONE = "\0"
#: Entries of all cumulative distributions together up to which they are broadcast (32 MB).
BROADCAST_ENTRIES = 1 << 22
#: Beyond that, rows of one source are joined in so many groups.
SALTS = 64
#: Rates above this are inverted by the expansion.
LARGE_RATE = 600.0
#: Copies that one piece of a row stands for.
PIECE = 4096

# Coefficients of the rational approximations of the normal quantile
# (Wichura's algorithm AS 241) for the middle, the tails and the far tails; numerator and
# denominator in ascending powers.
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _uniform(seed: str, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(seed), *parts)
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _ratio(table: tuple, x: Column) -> Column:
    top, bottom = (reduce(lambda out, c: out * x + F.lit(c), reversed(row[:-1]), F.lit(row[-1])) for row in table)
    return top / bottom


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normal_quantile(u: Column) -> Column:
    def of(u: Column) -> Column:
        q = u - F.lit(0.5)
        middle = q * _let(F.lit(0.180625) - q * q, lambda x: _ratio(MIDDLE, x))
        tail = _let(F.sqrt(-F.log(F.least(u, F.lit(1.0) - u))), lambda r: F.when(r <= 5, _let(r - F.lit(1.6), lambda x: _ratio(TAIL, x))).otherwise(_let(r - F.lit(5.0), lambda x: _ratio(FAR_TAIL, x))))
        return F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * tail)

    return _let(u, of)


def large_quantile(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) >= u for X of a large rate."""

    def of(w: Column) -> Column:
        fine = (-w / 36 - w * w * w / 72) / F.sqrt(rate) + (F.lit(-8 / 405) + w * w * F.lit(7 / 810) + w * w * w * w / 270) / rate
        return F.greatest(F.floor(rate + F.sqrt(rate) * w + F.lit(1 / 3) + w * w / 6 + fine).cast("long"), F.lit(0).cast("long"))

    return _let(normal_quantile(u), of)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to 1 in double precision."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.log(rate) - F.log(k.cast("double"))
        total = s["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(s["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])


def rates(docs: DataFrame, weights: dict[str | None, float] | DataFrame | None = None, scale: float = 1.0, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(origin, rate, cdf): one row a source; no cdf above LARGE_RATE."""
    docs, column = inner(docs)
    origin = F.coalesce(F.col(column[source_column]).cast("string"), F.lit(_NONE))
    mass = F.greatest(F.coalesce(F.length(column[text_column]), F.lit(0)), F.lit(1)).cast("double")
    sums = docs.groupBy(origin.alias("origin")).agg(F.sum(mass).alias("mass"))
    if isinstance(weights, dict):
        pairs = [(_NONE if k is None else k, float(v)) for k, v in weights.items()]
        weights = docs.sparkSession.createDataFrame(pairs, "origin string, weight double")
    sums = sums.withColumn("weight", F.lit(1.0)) if weights is None else sums.join(weights, "origin", "left").fillna(0.0, ["weight"])
    total = sums.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("weight") > 0, F.lit(float(scale)) * F.col("weight") / F.col("all_weight") * F.col("all_mass") / F.col("mass")).otherwise(F.lit(0.0))
    # one row beside one row a source
    found = sums.join(F.broadcast(total), F.lit(True)).select("origin", rate.alias("rate")).where("rate > 0")
    return found.withColumn("cdf", F.when(F.col("rate") <= LARGE_RATE, poisson_cdf(F.least("rate", F.lit(LARGE_RATE)))))


def mix(docs: DataFrame, weights: dict[str | None, float] | DataFrame | None = None, scale: float = 1.0, seed: str = "mix", id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", extra: bool = True) -> DataFrame:
    """The columns of ``docs`` in shuffled order, with ``extra`` also copy (from 1) and order_key."""
    if extra:
        docs = docs.drop("copy", "order_key")
    rows, column = inner(docs)
    key = F.coalesce(F.col(column[id_column]).cast("string"), F.md5(F.coalesce(F.col(column[text_column]).cast("string"), F.lit(""))))
    origin = F.coalesce(F.col(column[source_column]).cast("string"), F.lit(_NONE))
    drawn = rows.withColumns({"origin": origin, "key": key, "u": _uniform(seed, key)})
    known = cut(rates(docs, weights, scale, source_column, text_column))
    entries, most = known.agg(F.sum(F.coalesce(F.size("cdf"), F.lit(1))), F.max("rate")).first()
    on = ["origin"]
    if (entries or 0) <= BROADCAST_ENTRIES:
        known = F.broadcast(known)
    else:
        on = ["origin", "salt"]
        drawn = drawn.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    below = F.size(F.filter("cdf", lambda c: c <= F.col("u"))).cast("long")
    times = F.when(F.col("cdf").isNull(), large_quantile(F.col("rate"), F.col("u"))).otherwise(below)
    counted = drawn.join(known, on).withColumn("times", times).where("times > 0").select(*rows.columns, "key", "times")
    if (most or 0) + 12 * (most or 0) ** 0.5 + 30 <= PIECE:  # no count can exceed a piece
        copies = counted.select(*rows.columns, "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    else:
        pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {PIECE}"))))
        pieces = pieces.repartition(F.xxhash64("key", "piece"))
        end = F.least("times", (F.col("piece") + 1) * PIECE)
        copies = pieces.select(*rows.columns, "key", F.explode(F.sequence(F.col("piece") * PIECE + 1, end)).alias("copy"))
    out = copies.withColumn("order_key", _uniform(f"{seed}-order", F.col("key"), F.col("copy").cast("string"))).orderBy("order_key")
    return out.select(*rows.columns, "copy", "order_key").toDF(*docs.columns, "copy", "order_key") if extra else out.select(*rows.columns).toDF(*docs.columns)
