"""Exact vector search, BM25, hybrid merge and rerank for a batch of queries.

Queries are a stated set: ``queries(query_id, text)`` or ``queries(query_id, embedding)``,
handled in blocks. Everything else is partitioned by document: a task scores its documents
where they lie against a block of queries, keeps a running best k for each query over all
its batches, and emits them once, so the one shuffle sees k rows a query and task. BM25
counts the asked words of each document in one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.storage import cut

K1, B = 1.5, 0.75
#: How many more candidates than results are fetched from either side.
SEMANTIC_FACTOR, KEYWORD_FACTOR = 5, 10
#: Queries that a task holds at a time.
BLOCK_QUERIES = 4096
#: Documents scored at a time, and terms of a block that are multiplied at a time. A task's
#: memory follows these steps, not the rows that Spark hands over at once.
STEP_ROWS, STEP_TERMS = 256, 4096
#: Candidate ids up to which they are broadcast to the texts (16 MB), instead of shuffled.
BROADCAST_IDS = 1 << 21

_SCORED = "query_id long, id long, score double"


class _Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, ids: list[int], k: int):
        self.ids, self.k, self.floor = ids, k, None
        self.scores, self.keys = [np.zeros(0)] * len(ids), [np.zeros(0, dtype=np.int64)] * len(ids)

    def add(self, scores: np.ndarray, keys: np.ndarray, least: float) -> None:
        """``scores`` (query, row) of rows ``keys``; those up to ``least`` are no candidates."""
        if self.floor is None:
            self.floor = np.full(len(self.ids), np.nextafter(least, np.inf))
        near = scores >= self.floor[:, None]
        for q in np.flatnonzero(near.any(axis=1)):
            on = np.flatnonzero(near[q])
            s, i = np.concatenate([self.scores[q], scores[q, on]]), np.concatenate([self.keys[q], keys[on]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.keys[q] = s[order], i[order]
            if len(order) == self.k:
                self.floor[q] = self.scores[q][-1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for q, s, i in zip(self.ids, self.scores, self.keys):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q), pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])


def _blocks(rows: list, size: int = BLOCK_QUERIES) -> list[list]:
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def _united(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames) if frames else like.sparkSession.createDataFrame([], _SCORED)


def _cosine_map(ids: list, matrix: np.ndarray, k: int, decimals: int):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(ids, k)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                norm = np.linalg.norm(rows, axis=1)[:, None]
                scores = np.divide(rows @ unit.T, norm, out=np.zeros((len(rows), len(ids))), where=norm > 0)
                top.add(np.round(scores.T, decimals), part.column(0).to_numpy(), -np.inf)
        yield from top.rows()

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", decimals: int = 6) -> DataFrame:
    """(query_id, id, score, rank) of the k most similar rows by cosine; zero vectors score 0.

    Vectors that are null, hold null components or have another length than a query cannot
    be compared with it; rows and queries without an id are left out. Filter ``vectors``
    before the call: the filter reaches the scan.
    """
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    asked = queries.where(whole("embedding") & F.col("query_id").isNotNull()).select("query_id", "embedding").collect()  # the stated set
    by_size: dict[int, list] = {}
    for row in asked:
        by_size.setdefault(len(row[1]), []).append(row)
    found = []
    for size, rows in by_size.items():
        fit = vectors.where(whole(vector_column) & (F.size(vector_column) == size) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
        for block in _blocks(rows):
            matrix = np.array([r[1] for r in block], dtype=np.float64).reshape(len(block), -1)
            found.append(fit.mapInArrow(_cosine_map([r[0] for r in block], matrix, k, decimals), _SCORED))
    return best(_united(found, vectors), k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows a query by score, then id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _term_map(terms: list[str]):
    """(id, length, term, tf): how often a document holds each asked term, by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(terms, pa.string())
        for batch in (b.slice(at, STEP_ROWS) for b in batches for at in range(0, b.num_rows, STEP_ROWS)):
            words, n = batch.column(1), batch.num_rows
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
            at = pc.index_in(words.flatten(), value_set=values)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            pairs, counts = np.unique(np.repeat(np.arange(n), sizes)[known] * len(terms) + pc.drop_null(at).to_numpy().astype(np.int64), return_counts=True)
            ends = np.searchsorted(pairs, np.arange(n + 1) * len(terms)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(terms)), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *lists], names=["id", "length", "term", "tf"])

    return run


def _bm25_map(ids: list, weight: np.ndarray, k: int, mean: float, decimals: int):
    """``weight`` (term, query) is how often a query holds a term, times its idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(ids, k)
        used = np.flatnonzero(weight.any(axis=1))
        for batch in batches:
            for first in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(first, STEP_ROWS)
                n = part.num_rows
                row = np.repeat(np.arange(n), pc.list_value_length(part.column(2)).to_numpy())
                term, tf = (part.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                length = part.column(1).to_numpy()[row]
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                scores = np.zeros((n, len(ids)))
                for at in range(0, len(used), STEP_TERMS):
                    some = used[at : at + STEP_TERMS]
                    place = np.full(len(weight), -1)
                    place[some] = np.arange(len(some))
                    on = place[term] >= 0
                    dense = np.zeros((n, len(some)))
                    dense[row[on], place[term[on]]] = value[on]
                    scores += dense @ weight[some]
                top.add(np.round(scores.T, decimals), part.column(0).to_numpy(), 0.0)
        yield from top.rows()

    return run


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text", decimals: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best, filled up with documents of score 0 in id order.

    A word that a query repeats counts as often. N, the mean length and document
    frequencies are those of ``docs``, so filter it first. Rows and queries without an id
    are left out; a null text has no words.
    """
    docs, queries = docs.where(F.col(id_column).isNotNull()), queries.where("query_id is not null")
    # the stated set of queries, and with it the asked terms
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).collect()
    terms = sorted({r.term for r in asked})
    number = {t: i for i, t in enumerate(terms)}
    source = docs.select(F.col(id_column).cast("long").alias("id"), tokens(text_column).alias("words"))
    counted = cut(source.mapInArrow(_term_map(terms), "id long, length int, term array<int>, tf array<int>"))
    n, mean = counted.agg(F.count("*"), F.avg("length")).first()
    df = np.zeros(len(terms))
    for term, count in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # asked terms
        df[term] = count
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    by_query: dict[int, list] = {}
    for r in asked:
        by_query.setdefault(r.query_id, []).append((number[r.term], r.times))
    found = []
    for block in _blocks(sorted(by_query), 256):
        weight = np.zeros((len(terms), len(block)))
        for q, query in enumerate(block):
            for term, times in by_query[query]:
                weight[term, q] = times * idf[term]
        found.append(counted.mapInArrow(_bm25_map(block, weight, k, mean or 1.0, decimals), _SCORED))
    # only the k smallest ids can be needed to fill up a list of k
    first = docs.select(F.col(id_column).cast("long").alias("id")).distinct().orderBy("id").limit(k)
    filler = queries.select(F.col("query_id").cast("long").alias("query_id")).crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    return best(_united([*found, filler], docs).groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def merge_candidates(semantic: DataFrame, keyword: DataFrame, by: tuple[str, ...] = ("query_id", "id")) -> DataFrame:
    """Both score columns for every candidate of either side; a missing score is 0."""
    left = semantic.groupBy(*by).agg(F.max_by("score", "rank").alias("semantic"))
    right = keyword.groupBy(*by).agg(F.max_by("score", "rank").alias("keyword"))
    both = left.withColumn("_in_semantic", F.lit(1)).join(right.withColumn("_in_keyword", F.lit(1)), list(by), "full_outer")
    return both.select(*by, F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"), F.col("_in_semantic").isNotNull().alias("in_semantic"), F.col("_in_keyword").isNotNull().alias("in_keyword"))


def overlap(merged: DataFrame) -> DataFrame:
    """(query_id, overlap, proxy): shared candidates, and their share of the semantic side."""
    both = F.count_if(F.col("in_semantic") & F.col("in_keyword"))
    return merged.groupBy("query_id").agg(both.alias("overlap"), F.round(both / F.greatest(F.count_if("in_semantic"), F.lit(1)), 6).alias("proxy"))


def rerank(merged: DataFrame, docs: DataFrame, queries: DataFrame, semantic: float = 0.7, keyword: float = 0.3, lexical: float = 0.05, id_column: str = "doc_id", text_column: str = "text", decimals: int = 6) -> DataFrame:
    """Candidates with a weighted score of both sides, each relative to its query's best,
    and of the share of query words that the document holds."""
    # only the texts of candidates are read for words; they are as many as queries ask for
    merged = cut(merged)
    ids = merged.select("id").distinct()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    near = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).join(wanted, "id", "left_semi")
    texts = near.select("id", F.array_distinct(tokens("text")).alias("words"))
    asked = queries.select("query_id", F.array_distinct(tokens("text")).alias("asked"))
    # the best of a query is an aggregate beside its candidates, not an unpartitioned window
    tops = merged.groupBy("query_id").agg(F.max("semantic").alias("top_semantic"), F.max("keyword").alias("top_keyword"))
    rows = merged.join(tops, "query_id").join(asked, "query_id").join(texts, "id")

    def share(x: str, top: str) -> Column:
        return F.when(F.col(top) > 0, F.col(x) / F.col(top)).otherwise(F.lit(0.0))

    hits = F.size(F.array_intersect("asked", "words")) / F.greatest(F.size("asked"), F.lit(1))
    total = F.lit(semantic) * share("semantic", "top_semantic") + F.lit(keyword) * share("keyword", "top_keyword") + F.lit(lexical) * hits
    return rows.select("query_id", "id", "semantic", "keyword", F.round(total, decimals).alias("score"))


def hybrid_topk(docs: DataFrame, vectors: DataFrame, text_queries: DataFrame, vector_queries: DataFrame, k: int = 50, reranker=None) -> DataFrame:
    """(query_id, id, semantic, keyword, score, rank): vector and BM25 candidates merged,
    reranked and cut. ``reranker(merged, docs, queries)`` may replace the weighted sum."""
    semantic = vector_topk(vectors, vector_queries, k * SEMANTIC_FACTOR)
    keyword = bm25_topk(docs, text_queries, k * KEYWORD_FACTOR)
    return best((reranker or rerank)(merge_candidates(semantic, keyword), docs, text_queries), k)


def multi_query(ranked: DataFrame, limit: int = 5, cap: int = 15) -> DataFrame:
    """One deduplicated context from several queries of an agent.

    ranked(agent, query_no, rank, key): the first ``limit`` of each query in order, the
    first of each key wins, ``cap`` rows an agent.
    """
    near = ranked.where(F.col("rank") <= limit)
    seen = Window.partitionBy("agent", "key").orderBy("query_no", "rank")
    firsts = near.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")
    order = Window.partitionBy("agent").orderBy("query_no", "rank")
    return firsts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap)


def context_budget(blocks: DataFrame, by: str, order: tuple[str, ...], text_column: str = "text", budget: int = 4000) -> DataFrame:
    """The leading blocks of each group whose running length stays within the budget."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("running", F.sum(F.length(text_column)).over(upto)).where(F.col("running") <= budget)


def row_key(*hashes: str, path: str = "file_path", line: str = "start_line") -> Column:
    """The first hash that is there, else path and line."""
    known = [F.nullif(F.col(h), F.lit("")) for h in hashes]
    return F.coalesce(*known, F.concat_ws(":", F.col(path), F.col(line).cast("string")))


def merge_keyed(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """(query_id, key, semantic, keyword, n_semantic, n_keyword) of rows (query_id, position, key, score).

    Rows of one key and query are one candidate; the last of each side gives its score, a
    side without it 0. The counts say how many rows of a side fell together.
    """
    sides = [rows.groupBy("query_id", "key").agg(F.max_by("score", "position").alias(name), F.count("*").alias(f"n_{name}")) for name, rows in (("semantic", semantic), ("keyword", keyword))]
    return sides[0].join(sides[1], ["query_id", "key"], "full_outer").fillna(0, ["semantic", "keyword", "n_semantic", "n_keyword"]).select("query_id", "key", "semantic", "keyword", "n_semantic", "n_keyword")


def merge_metrics(merged: DataFrame) -> DataFrame:
    """Candidates of each side, merged ones, their overlap and its share of the semantic keys."""
    s, k = F.col("n_semantic") > 0, F.col("n_keyword") > 0
    both = F.count_if(s & k)
    return merged.groupBy("query_id").agg(F.sum("n_semantic").alias("semantic_candidates"), F.sum("n_keyword").alias("keyword_candidates"), F.count("*").alias("merged_candidates"), both.alias("overlap"), F.round(both / F.greatest(F.count_if(s), F.lit(1)), 6).alias("precision_proxy"))


# The fields of a result.
RESULT_FIELDS = ("content", "file_path", "language", "symbol_name", "chunk_type", "start_line", "end_line", "sha256", "semantic_score", "bm25_score", "rerank_score")


def result_rows(ranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query with all fields of a result; one that is missing is null,
    and a content_hash stands for a missing sha256."""
    there = set(ranked.columns)
    out = {c: F.col(c) if c in there else F.lit(None).cast("string") for c in RESULT_FIELDS}
    if "content_hash" in there:
        out["sha256"] = F.coalesce(F.nullif(out["sha256"], F.lit("")), F.col("content_hash"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", *[c.alias(name) for name, c in out.items()])


def matches(language: str | None = None, metadata: dict[str, str] | None = None, language_column: str = "language", metadata_column: str = "metadata") -> Column:
    """Whether a row passes: a row without a language passes any; every metadata entry must be equal."""
    tests = [F.lit(True)]
    if language:
        tests.append(F.coalesce(F.col(language_column), F.lit("")).isin("", language))
    tests += [F.try_element_at(metadata_column, F.lit(k)).eqNullSafe(F.lit(v)) for k, v in (metadata or {}).items()]
    return reduce(lambda a, b: a & b, tests)
