"""An inverted index on shared storage, with score bounds by block and generations.

Documents lie in segments of ``SEGMENT`` rows, ordered by their most frequent word and their
length, so that rows of a segment are alike. A block holds the postings of one term in one
segment. Below the index path are, each by generation (``gen``),

* ``docs``: id, digest, length, distinct terms and their counts;
* ``blocks``: the postings, in one partition (``zone``) a writing task;
* ``bounds``: for each block its size, largest count and smallest length, by term bucket;
* ``dead``, ``dead_terms``: ids whose rows of older generations no longer hold, and how many
  of those rows held each term;
* ``totals``: the rows and words that the generation adds. It is written last and commits the
  generation: one without it is not read, and the next ``refresh`` writes it anew.

BM25 grows with a term's count and falls with the length, so largest count and smallest length
bound every row of a block whatever the mean length is; bounds stay valid as rows die.
``search`` sums the bounds of a query by segment, scores its best ``SEEDS`` segments, and then
only the segments whose bound reaches the k-th best score. Its rows are those of ``bm25_topk``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.storage import cut, dealt
from .retrieval import BROADCAST_IDS, K1, STEP_ROWS, B, _blocks, best

#: Documents of a segment, about as many documents of a zone, partitions of the bounds.
SEGMENT, ZONE, BUCKETS = 64, 1 << 18, 64
#: Segments of a query that are scored before its threshold is known.
SEEDS = 8
#: Scores are compared after rounding to six decimals.
_SLACK = 1e-6

_DOCS = "id long, digest string, length int, terms array<string>, tfs array<int>, gen int"
_BLOCKS = "segment long, term string, n int, max_tf int, min_length int, ids array<long>, slots array<int>, tfs array<int>, lengths array<int>, gen int, zone int"
_BOUNDS = "segment long, term string, n int, max_tf int, min_length int, zone int, gen int, bucket int"


def _vector_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, words) with its length, distinct words and their counts."""
    for batch in (b.slice(at, STEP_ROWS) for b in batches for at in range(0, b.num_rows, STEP_ROWS)):
        n = batch.num_rows
        sizes = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy().astype(np.int64)
        coded = batch.column(2).flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        pairs, counts = np.unique(np.repeat(np.arange(n), sizes) * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * width).astype(np.int32))
        terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % width)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), terms, pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], names=["id", "digest", "length", "terms", "tfs"])


def _block_map(gen: int):
    """Rows (id, length, terms, tfs) of a task as blocks of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(at, SEGMENT)
                slot = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())
                if not len(slot):
                    continue
                coded = part.column(2).flatten().dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                code, slot = code[order], slot[order]
                tf, length, ids = part.column(3).flatten().to_numpy()[order], part.column(1).to_numpy()[slot], part.column(0).to_numpy()[slot]
                first = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
                ends = pa.array(np.append(first, len(code)).astype(np.int32))
                segment = (gen << 48) + (zone << 24) + number
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), segment)), coded.dictionary.take(pa.array(code[first])), pa.array(np.diff(first, append=len(code)).astype(np.int32)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length, first))]
                    + [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, slot.astype(np.int32), tf, length)]
                    + [pa.array(np.full(len(first), zone, dtype=np.int32))],
                    names=["segment", "term", "n", "max_tf", "min_length", "ids", "slots", "tfs", "lengths", "zone"],
                )

    return run


def _table(spark: SparkSession, path: str, name: str, schema: str, gens: list[int]) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("gen").isin(gens))


def generations(spark: SparkSession, path: str) -> list[int]:
    """The committed generations, one row each."""
    return sorted(r.gen for r in spark.read.schema("docs long, words long, gen int").parquet(f"{path}/totals").select("gen").collect())


def _dead(spark: SparkSession, path: str, gens: list[int]) -> DataFrame:
    """(id, dead): rows of the id hold only from generation ``dead`` on."""
    return _table(spark, path, "dead", "id long, gen int", gens).groupBy("id").agg(F.max("gen").alias("dead"))


def _live(rows: DataFrame, spark: SparkSession, path: str, gens: list[int]) -> DataFrame:
    if len(gens) < 2:
        return rows
    dead = _dead(spark, path, gens)
    few = dead.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(dead) if few else dead, "id", "left").where("dead is null or gen >= dead").drop("dead")


def _write(rows: DataFrame, path: str, gen: int, dead: DataFrame, n_dead: tuple[int, int], dead_terms: DataFrame) -> None:
    """Generation ``gen`` of ``rows`` (id, digest, words), committed by its totals."""
    spark = rows.sparkSession
    rows.mapInArrow(_vector_map, "id long, digest string, length int, terms array<string>, tfs array<int>").write.mode("overwrite").parquet(f"{path}/docs/gen={gen}")
    docs = _table(spark, path, "docs", _DOCS, [gen])
    n, words = docs.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    top = F.try_element_at("terms", F.array_position("tfs", F.array_max("tfs")).cast("int"))
    order = [top, "length", "id", "digest"]
    zones = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ZONE))
    dealt = docs.where("length > 0").repartitionByRange(zones, *order).sortWithinPartitions(*order).select("id", "length", "terms", "tfs")
    shape = _BLOCKS.replace(", gen int", "")
    dealt.mapInArrow(_block_map(gen), shape).write.mode("overwrite").partitionBy("zone").parquet(f"{path}/blocks/gen={gen}")
    told = _table(spark, path, "blocks", _BLOCKS, [gen]).select("segment", "term", "n", "max_tf", "min_length", "zone", _bucket().alias("bucket"))
    told.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bounds/gen={gen}")
    dead.write.mode("overwrite").parquet(f"{path}/dead/gen={gen}")
    dead_terms.write.mode("overwrite").parquet(f"{path}/dead_terms/gen={gen}")
    spark.createDataFrame([(n - n_dead[0], words - n_dead[1])], "docs long, words long").write.mode("overwrite").parquet(f"{path}/totals/gen={gen}")


def _bucket() -> Column:
    return F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column)
    return docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"), tokens(text).alias("words"))


def build(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Write an index of all rows that have an id to ``path``, which holds none yet. A null text has no words."""
    spark = docs.sparkSession
    _write(_rows(docs, id_column, text_column), path, 0, spark.createDataFrame([], "id long"), (0, 0), spark.createDataFrame([], "term string, n long"))
    return path


def refresh(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> dict[str, int]:
    """Bring an index up to ``docs``: only rows of new or changed ids are indexed, rows of
    changed and missing ids die. Rows of one id change together. Returns how many ids were
    added, changed and removed; a run that changes nothing writes nothing."""
    spark = docs.sparkSession
    gens = generations(spark, path)
    rows = _rows(docs, id_column, text_column)
    held = _live(_table(spark, path, "docs", _DOCS, gens), spark, path, gens)

    def state(df: DataFrame, name: str) -> DataFrame:
        several = F.bit_xor(F.xxhash64("digest"))
        return df.groupBy("id").agg(F.struct(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"), several.alias("x")).alias(name))

    both = state(rows.select("id", "digest"), "now").join(state(held.select("id", "digest"), "was"), "id", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    moved = cut(both.where(~F.col("now").eqNullSafe(F.col("was"))).select("id", kind.alias("kind")))
    counts = dict(moved.groupBy("kind").count().collect())  # three numbers
    out = {k: counts.get(k, 0) for k in ("added", "changed", "removed")}
    if not any(out.values()):
        return out
    gone = moved.where("kind <> 'added'").select("id")
    few = sum(out.values()) <= BROADCAST_IDS

    def of(df: DataFrame, ids: DataFrame) -> DataFrame:
        return df.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    dying = of(held, gone)
    n_dead = tuple(dying.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())
    terms = dying.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    _write(of(rows, moved.where("kind <> 'removed'").select("id")), path, gens[-1] + 1, gone, n_dead, terms)
    return out


def _value(tf: str, length: str, mean: float) -> Column:
    """What a term adds to a score, before its weight."""
    count = F.col(tf).cast("double")
    return count * F.lit(K1 + 1) / (count + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(length) / F.lit(mean)))


def _score_map(asked: list, ids: list, mean: float, floor: dict[int, float], pairs: dict[int, list[int]] | None):
    """Scores of the rows of whole segments, whose blocks follow each other."""
    number = {t: i for i, t in enumerate(sorted({r.term for r in asked}))}
    place = {q: i for i, q in enumerate(ids)}
    weight = np.zeros((len(number), len(ids)))
    for r in asked:
        if r.query_id in place:
            weight[number[r.term], place[r.query_id]] = r.weight
    least, queries = np.array([floor.get(q, 0.0) for q in ids]), np.array(ids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held = pa.array(list(number), pa.string()), None

        def whole(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            code = pc.index_in(rows.column("term"), value_set=terms).to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column("ids")).to_numpy())])
            block = np.repeat(np.arange(rows.num_rows), np.diff(ends))
            key, slot, tf, length = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("ids", "slots", "tfs", "lengths"))
            value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            segments = rows.column("segment").to_numpy()
            for a, b in zip(starts[:-1], starts[1:]):
                on = slice(ends[a], ends[b])
                dense, keys = np.zeros((SEGMENT, b - a)), np.zeros(SEGMENT, dtype=np.int64)
                dense[slot[on], block[on] - a], keys[slot[on]] = value[on], key[on]
                scores = dense @ weight[code[a:b]]
                good = (scores > 0) & (scores >= least)
                if pairs is not None:
                    good &= np.isin(queries, pairs.get(segments[a], []))
                row, q = np.nonzero(good)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(np.full(len(row), segments[a] >> 48, dtype=np.int32)), pa.array(keys[row]), pa.array(scores[row, q])], names=["query_id", "gen", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            starts = np.flatnonzero(np.diff(rows.column("segment").to_numpy(), prepend=-1))
            yield from whole(rows.slice(0, starts[-1]), starts)
            held = rows.slice(starts[-1])
        if held is not None:
            yield from whole(held, np.array([0, held.num_rows]))

    return run


class _Search:
    """One query set against an index: bounds by (query, segment) and the rows scored."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame):
        self.spark, self.path, self.gens = spark, path, generations(spark, path)
        self.n, words = _table(spark, path, "totals", "docs long, words long, gen int", self.gens).agg(F.sum("docs"), F.sum("words")).first()
        self.mean = words / self.n if words else 1.0
        terms = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokens("text")).alias("term"))
        asked = cut(terms.groupBy("query_id", "term").agg(F.count("*").alias("times")))
        few = asked.count() <= BROADCAST_IDS
        small = F.broadcast if few else (lambda df: df)
        buckets = [r[0] for r in asked.select(_bucket()).distinct().collect()]  # at most BUCKETS
        bounds = _table(spark, path, "bounds", _BOUNDS, self.gens).where(F.col("bucket").isin(buckets))
        held = bounds.join(small(asked.select("term").distinct()), "term", "left_semi").select("term", F.col("n").cast("long"))
        dead = _table(spark, path, "dead_terms", "term string, n long, gen int", self.gens).select("term", (-F.col("n")).alias("n"))
        df = held.union(dead).groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = cut(asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")))
        self.asked = self.weights.collect()  # the stated set of queries
        self.terms = self.weights.select("term").distinct()
        value = F.col("weight") * _value("max_tf", "min_length", self.mean)
        met = bounds.join(small(self.weights), "term")
        self.bounds = cut(met.groupBy("query_id", "gen", "zone", "segment").agg(F.sum(value).alias("bound"), F.count("*").alias("blocks")))

    def scored(self, chosen: DataFrame, floor: dict[int, float], few: bool = False) -> DataFrame:
        """(query_id, id, score) of live rows of positive score in the ``chosen`` segments, those
        below a query's ``floor`` left out; of a ``few`` segments only for the queries that chose
        them, else for any that they suit. A segment's blocks meet once for all queries and are
        summed where they meet, so that no posting is copied for a query."""
        zones: dict[int, list[int]] = {}
        for r in chosen.select("gen", "zone").distinct().collect():  # as many as files were written
            zones.setdefault(r.gen, []).append(r.zone)
        inside = [(F.col("gen") == g) & F.col("zone").isin(z) for g, z in sorted(zones.items())]
        blocks = _table(self.spark, self.path, "blocks", _BLOCKS, self.gens).where(reduce(lambda a, b: a | b, inside, F.lit(False)))
        segments = chosen.select("segment").distinct()
        pairs: dict[int, list[int]] | None = {} if few else None
        for r in chosen.select("segment", "query_id").collect() if few else ():  # a few a query
            pairs.setdefault(r.segment, []).append(r.query_id)
        some = F.broadcast(segments) if segments.count() <= BROADCAST_IDS else segments
        needed = blocks.join(F.broadcast(self.terms), "term", "left_semi").join(some, "segment", "left_semi")
        rows = dealt(needed.select("segment", "term", "ids", "slots", "tfs", "lengths"), "segment").sortWithinPartitions("segment")
        found = [rows.mapInArrow(_score_map(self.asked, block, self.mean, floor, pairs), "query_id long, gen int, id long, score double") for block in _blocks(sorted({r.query_id for r in self.asked}), 256)]
        none = self.spark.createDataFrame([], "query_id long, gen int, id long, score double")
        return _live(reduce(DataFrame.union, found, none), self.spark, self.path, self.gens).select("query_id", "id", "score")

    def run(self, k: int, decimals: int) -> tuple[DataFrame, DataFrame]:
        """The k best rows of positive score, and the (query, segment) pairs that were read."""

        def top(rows: DataFrame) -> DataFrame:
            one = rows.groupBy("query_id", "id").agg(F.max(F.round("score", decimals)).alias("score"))
            return cut(best(one.where("score > 0"), k).select("query_id", "id", "score"))

        first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment")
        seeds = cut(self.bounds.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max(SEEDS, -(-k // SEGMENT))).drop("_r"))
        found = top(self.scored(seeds, {}, True))
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        left = self.bounds.join(seeds.select("query_id", "segment"), ["query_id", "segment"], "left_anti").join(least, "query_id", "left")
        rest = cut(left.where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - F.lit(_SLACK + 0.5 * 10.0**-decimals)).select(*self.bounds.columns))
        floor = {r.query_id: r.least - _SLACK - 0.5 * 10.0**-decimals for r in least.where("least is not null").collect()}  # one a query
        return top(found.union(self.scored(rest, floor))), seeds.union(rest)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 50, decimals: int = 6) -> DataFrame:
    """(query_id, id, score, rank) as ``bm25_topk`` gives them on the rows that live."""
    queries = queries.where("query_id is not null")
    made = _Search(spark, path, queries)
    found, _ = made.run(k, decimals)
    # only the k smallest ids can be needed to fill up a list of k
    ids = _live(_table(spark, path, "docs", _DOCS, made.gens).select("id", "gen"), spark, path, made.gens)
    first = [r.id for r in ids.select("id").distinct().orderBy("id").limit(k).collect()]
    filler = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.lit(first).cast("array<bigint>")).alias("id")).withColumn("score", F.lit(0.0))
    return best(found.union(filler).groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def blocks_read(spark: SparkSession, path: str, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, held, read): blocks of its terms in the index, and those a search scores."""
    made = _Search(spark, path, queries.where("query_id is not null"))
    _, read = made.run(k, 6)
    some = read.groupBy("query_id").agg(F.sum("blocks").alias("read"))
    return made.bounds.groupBy("query_id").agg(F.sum("blocks").alias("held")).join(some, "query_id")
