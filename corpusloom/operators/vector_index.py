"""A vector index on shared storage: cells of coarse centroids with residual codes.

``build`` writes every vector to the Parquet partition of its nearest centroid, and of a
payload column if one is named: its id, its residual as one byte a component, what that
rounding loses, and the vector itself. ``search`` reads the codes of the cells that queries
probe, pruned by partition; code and loss bound each cosine from both sides, so only rows
that may be among the k best are scored on their whole vectors. Of equal vectors, which a
hash beside the code tells, a task passes on the k of smallest id. Probes are widened until

* ``recall`` below 1: an audit of a sample of the queries against brute force finds that
  share, or
* ``recall`` 1: no cell left can hold a better row, by the widest angle of a cell's members
  to its centroid. Results are then those of ``vector_topk``.

Centroids are fitted on a bounded sample (``SAMPLE`` rows); every row is indexed. A query
reads a bounded number of cells, and neither queries nor rows are shuffled by a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut
from .retrieval import BLOCK_QUERIES, BROADCAST_IDS, STEP_ROWS, _blocks, best, vector_topk

#: Rows that the centroids are fitted on, about; centroids at most; rows of one cell, about.
SAMPLE, MAX_CELLS, CELL_ROWS = 16_384, 4096, 4096
#: Queries that an audit answers by brute force.
AUDITED = 64
#: Cell of vectors without a direction, whose cosine with any other is 0.
ZERO = -1
_SLACK = 1e-6
#: Candidates of a query beyond which a task looks for equal vectors among them.
HELD = 1 << 14

_ROWS = "id long, embedding array<double>, twin long, angle double, code binary, step double, loss double, cell int, payload string"


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, its centroids and the widest angle of each cell."""

    path: str
    cells: np.ndarray
    centroids: np.ndarray
    widest: np.ndarray


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0), norm[:, 0] > 0


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    middle = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ middle.T, axis=1)
        total = np.zeros_like(middle)
        np.add.at(total, own, sample)
        found, some = _unit(total)
        middle[some] = found[some]
    return middle


def _code_map(middle: np.ndarray):
    """(id, payload, vector) with its cell, angle to the centroid, code, step and loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = middle.shape[1]
        for batch in batches:
            unit, some = _unit(_matrix(batch.column(2), dims))
            sims = unit @ middle.T
            own = np.argmax(sims, axis=1)
            rest = unit - middle[own]
            step = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            code = np.rint(rest / step[:, None]).astype(np.int8)
            loss = np.linalg.norm(rest - code * step[:, None], axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(own)), own], -1, 1))
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.where(some, own, ZERO).astype(np.int32)), pa.array(angle), codes, pa.array(step), pa.array(loss)], names=["id", "payload", "embedding", "cell", "angle", "code", "step", "loss"])

    return run


def build(vectors: DataFrame, path: str, dims: int, payload: str | None = None, cells: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> VectorIndex:
    """Write an index of all vectors of ``dims`` sound components that have an id."""
    x = F.col(vector_column)
    sound = x.isNotNull() & (F.size(x) == dims) & ~F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))) & F.col(id_column).isNotNull()
    kept = F.col(payload).cast("string") if payload else F.lit(None).cast("string")
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), kept.alias("payload"), x.cast("array<double>").alias("embedding"))
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < SAMPLE).select("id", "embedding").limit(4 * SAMPLE).collect()
    sample, on = _unit(np.array([r.embedding for r in sorted(some)], dtype=np.float64).reshape(-1, dims))
    middle = _centroids(sample[on], min(MAX_CELLS, cells or -(-n // CELL_ROWS))) if on.any() else np.zeros((1, dims))
    shape = "id long, payload string, embedding array<double>, cell int, angle double, code binary, step double, loss double"
    by = ["cell", "payload"] if payload else ["cell"]
    coded = rows.mapInArrow(_code_map(middle), shape).withColumn("twin", F.xxhash64("embedding"))
    # files by cell; adaptive execution splits a cell that holds much of the table
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy(*by).parquet(f"{path}/rows")
    spark = vectors.sparkSession
    widest = spark.read.schema(_ROWS).parquet(f"{path}/rows").groupBy("cell").agg(F.max("angle").alias("widest"), F.count("*").alias("n"))
    told = spark.createDataFrame([(i, c) for i, c in enumerate(middle.tolist())] + [(ZERO, [0.0] * dims)], "cell int, centroid array<double>")
    told.join(F.broadcast(widest), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build`` wrote; its cells, at most MAX_CELLS rows, come to the driver."""
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    return VectorIndex(path, np.array([r.cell for r in cells]), np.array([r.centroid for r in cells]), np.array([r.widest for r in cells]))


def _firsts(key: np.ndarray, high: np.ndarray, cell: np.ndarray, twin: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k smallest ids of every group of equal vectors."""
    order = np.lexsort((key, high, twin))
    new = np.concatenate([[True], (np.diff(twin[order]) != 0) | (np.diff(high[order]) != 0)])
    start = np.flatnonzero(new)
    kept = np.sort(order[np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order))) < k])
    return key[kept], high[kept], cell[kept], twin[kept]


def _candidate_map(ids: list, asked: np.ndarray, probes: dict[int, np.ndarray], middle: dict[int, np.ndarray], k: int):
    """(query_id, id, cell): the rows that may be among a task's k best of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full((len(ids), k), -np.inf)  # the k best lower bounds of each query
        held = [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in ids]
        for whole in batches:
            for first in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(first, STEP_ROWS)
                cell = batch.column(1).to_numpy()
                for c in np.unique(cell).tolist():
                    part = batch.take(pa.array(np.flatnonzero(cell == c)))
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.int8).reshape(part.num_rows, -1)
                    rows = (middle[c] + code * part.column(3).to_numpy()[:, None]) * (c != ZERO)
                    loss, key, twin = part.column(4).to_numpy() + _SLACK, part.column(0).to_numpy(), part.column(5).to_numpy()
                    for q, sims in zip(probes[c].tolist(), asked[probes[c]] @ rows.T):
                        low, high = sims - loss, sims + loss
                        floor[q] = np.sort(np.concatenate([floor[q], np.partition(low, -k)[-k:] if len(low) > k else low]))[-k:]
                        on = high >= floor[q, 0]
                        if on.any():
                            held[q] = tuple(np.concatenate(x) for x in zip(held[q], (key[on], high[on], np.full(int(on.sum()), c), twin[on])))
                            if len(held[q][0]) > HELD:
                                on = held[q][1] >= floor[q, 0]
                                held[q] = _firsts(*(x[on] for x in held[q]), k)
        for q, (key, high, c, twin) in enumerate(held):
            on = high >= floor[q, 0]
            if on.any():
                key, high, c, twin = _firsts(key[on], high[on], c[on], twin[on], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), ids[q]), pa.int64()), pa.array(key), pa.array(c.astype(np.int32))], names=["query_id", "id", "cell"])

    return run


def _score_map(ids: list, asked: np.ndarray, decimals: int):
    number = {q: i for i, q in enumerate(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = _unit(_matrix(batch.column(2), asked.shape[1]))
            mine = asked[[number[q] for q in batch.column(0).to_pylist()]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.einsum("ij,ij->i", rows, mine), decimals))], names=["query_id", "id", "score"])

    return run


def _probed(index: VectorIndex, stored: DataFrame, ids: list, asked: np.ndarray, chosen: np.ndarray, k: int, decimals: int) -> DataFrame:
    """(query_id, id, score): the k best of the ``chosen`` (query, cell place) cells."""
    probes = {int(index.cells[j]): np.flatnonzero(chosen[:, j]) for j in np.flatnonzero(chosen.any(axis=0))}
    middle = {int(c): m for c, m in zip(index.cells, index.centroids)}
    some = stored.where(F.col("cell").isin(list(probes)))
    codes = some.select("id", "cell", "code", "step", "loss", "twin")
    found = cut(codes.mapInArrow(_candidate_map(ids, asked, probes, middle, k), "query_id long, id long, cell int"))
    few = found.count() <= BROADCAST_IDS
    met = some.select("id", "cell", "embedding").join(F.broadcast(found) if few else found, ["cell", "id"])
    scored = met.select("query_id", "id", "embedding").mapInArrow(_score_map(ids, asked, decimals), "query_id long, id long, score double")
    return cut(best(scored, k).select("query_id", "id", "score"))


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = 10, recall: float = 0.9, where: list[str] | None = None, decimals: int = 6) -> DataFrame:
    """(query_id, id, score, rank) of the k most similar rows; ``where`` lists the payload
    values that are searched. Queries that cannot be compared with the index have no rows."""
    if not len(index.cells):
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    dims = index.centroids.shape[1]
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.col("query_id").isNotNull()
    given = sorted(queries.where(whole & ~F.exists("embedding", lambda x: x.isNull())).select(F.col("query_id").cast("long"), "embedding").collect())  # the stated set
    stored = spark.read.schema(_ROWS).parquet(f"{index.path}/rows")
    if where is not None:
        stored = stored.where(F.col("payload").isin(where))
    out = []
    still = [r for r in given if not any(r[1])]  # any row is as good: the smallest ids
    if still:
        out.append(vector_topk(stored.select("id", "embedding"), spark.createDataFrame(still, "query_id long, embedding array<double>"), k, id_column="id", decimals=decimals).select("query_id", "id", "score"))
    for block in _blocks([r for r in given if any(r[1])], BLOCK_QUERIES):
        out.append(_search_block(index, stored, [r[0] for r in block], _unit(np.array([r[1] for r in block], dtype=np.float64))[0], k, recall, decimals))
    if not out:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    return best(reduce(DataFrame.union, out), k)


def _search_block(index: VectorIndex, stored: DataFrame, ids: list, asked: np.ndarray, k: int, recall: float, decimals: int) -> DataFrame:
    spark = stored.sparkSession
    away = np.arccos(np.clip(asked @ index.centroids.T, -1, 1))
    most = np.cos(np.maximum(away - index.widest - 1e-7, 0))  # no member of the cell is nearer
    most[:, index.cells == ZERO] = 0.0
    order = np.argsort(away - (index.widest if recall >= 1 else 0), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    probes, done, open_ = max(1, len(index.cells) // 8), 0, np.ones(len(ids), dtype=bool)
    truth, found = None, None
    while True:
        chosen = (rank >= done) & (rank < probes) & open_[:, None]
        more = _probed(index, stored, ids, asked, chosen, k, decimals)
        found = more if found is None else cut(best(found.union(more), k).select("query_id", "id", "score"))
        if probes >= len(index.cells):
            return found
        if recall >= 1:
            worst = {r[0]: r[1] for r in found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score"))).collect() if r[1] is not None}  # a number a query
            left = np.where(rank >= probes, most, -2.0).max(axis=1)
            open_ = np.array([left[i] + _SLACK >= worst.get(q, -2.0) for i, q in enumerate(ids)])
            if not open_.any():
                return found
        else:
            if truth is None:
                audit = np.unique(np.linspace(0, len(ids) - 1, AUDITED).astype(int)).tolist()
                some = spark.createDataFrame([(ids[i], asked[i].tolist()) for i in audit], "query_id long, embedding array<double>")
                truth = {(r[0], r[1]) for r in vector_topk(stored.select("id", "embedding"), some, k, id_column="id", decimals=decimals).select("query_id", "id").collect()}
                sample = [ids[i] for i in audit]
            got = {(r[0], r[1]) for r in found.where(F.col("query_id").isin(sample)).select("query_id", "id").collect()}
            if len(got & truth) >= recall * len(truth):
                return found
        done, probes = probes, 2 * probes
