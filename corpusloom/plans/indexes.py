"""Named queries over indexes that are written, read back and pruned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import inverted_index, merge_table, retrieval, vector_index
from ..sources.storage import load, shared_dir
from .catalog import _bm25_sql, _every_20th, _text_queries, _vector_sql, query


def _vector_index(spark, sf):
    return vector_index.build(load(spark, sf, "embeddings"), f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}", 64, payload="label", cells=16)


@query(f"WITH {_vector_sql('', 10, 'q.vec_id % 20 = 0')} SELECT * FROM semantic")
def vector_index_topk(spark, sf):
    """Exact: probes widen until no cell left can hold a better row."""
    return vector_index.search(spark, _vector_index(spark, sf), _every_20th(spark, sf), 10, recall=1.0)


@query(f"WITH {_vector_sql('AND v.label IN (1, 2, 3)', 10, 'q.vec_id % 20 = 0')} SELECT * FROM semantic")
def vector_index_topk_filtered(spark, sf):
    """The payload prunes partitions before the cells do."""
    return vector_index.search(spark, _vector_index(spark, sf), _every_20th(spark, sf), 10, recall=1.0, where=["1", "2", "3"])


@query()
def vector_index_recall(spark, sf):
    """For every query, how many of the true ten an audited search finds."""
    asked = _every_20th(spark, sf)
    found = vector_index.search(spark, _vector_index(spark, sf), asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    true = retrieval.vector_topk(load(spark, sf, "embeddings"), asked, 10)
    return true.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


def _text_index(spark, docs):
    return inverted_index.build(docs, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}")


@query(f"WITH {_bm25_sql('', 10)} SELECT * FROM keyword")
def bm25_index_topk(spark, sf):
    """Only segments whose bound reaches the tenth score are read."""
    return inverted_index.search(spark, _text_index(spark, load(spark, sf, "documents")), _text_queries(spark, sf), 10)


@query(f"WITH {_bm25_sql('', 10)} SELECT * FROM keyword")
def bm25_index_refreshed(spark, sf):
    """An older state (texts of every fifth id differ, benchmark texts are rows too) brought up to date."""
    docs, more = load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "benchmark")
    older = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("an older text "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    path = _text_index(spark, docs.select("doc_id", older.alias("text")).union(more.select((-1 - F.col("item_id")).alias("doc_id"), "text")))
    inverted_index.refresh(docs, path)
    return inverted_index.search(spark, path, _text_queries(spark, sf), 10)


@query()
def bm25_index_blocks(spark, sf):
    """For every query, the blocks that the index holds of its words and those that are read."""
    return inverted_index.blocks_read(spark, _text_index(spark, load(spark, sf, "documents")), _text_queries(spark, sf), 10)


@query("SELECT doc_id, lang, sha256(CASE WHEN lang = 'en' THEN text ELSE text || '!' END) AS h FROM documents WHERE lang IS DISTINCT FROM 'fr'")
def merged_batches(spark, sf):
    """All documents in one batch, then English ones anew and French ones deleted, by a batch that comes twice."""
    docs, path = load(spark, sf, "documents"), f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    merge_table.merge(docs.select("doc_id", "lang", F.sha2(F.concat("text", F.lit("!")), 256).alias("h")), path, "doc_id", "first")
    for _ in range(2):
        merge_table.merge(docs.where("lang = 'en'").select("doc_id", "lang", F.sha2("text", 256).alias("h")), path, "doc_id", "second", docs.where("lang = 'fr'"))
    return merge_table.read(spark, path, "doc_id long, lang string, h string")
