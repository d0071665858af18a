"""Answers from retrieved context: gate, budget, a pluggable model, grounding guard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_block, grounded
from .retrieval import context_budget

REFUSAL = "I cannot answer from the given sources."
Model = Callable[[list[str], list[str]], list[str]]


def ready(repositories: DataFrame) -> DataFrame:
    """Only repositories whose index is complete may be asked."""
    return repositories.where(F.col("status") == "ready")


def contexts(ranked: DataFrame, chunks: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, context, sources): cited blocks of the best chunks that fit the budget.

    ranked(query_id, id, rank); chunks(id, file_path, symbol_name, start_line, end_line, content)
    """
    rows = ranked.select("query_id", "id", "rank").join(chunks, "id")
    block = context_block(F.col("file_path"), F.col("symbol_name"), F.col("start_line"), F.col("end_line"), F.col("content"))
    kept = context_budget(rows.withColumn("text", block), "query_id", ("rank",), "text", budget)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "file_path")))
    return kept.groupBy("query_id").agg(ordered.alias("b")).select("query_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("context"), F.array_distinct(F.transform("b", lambda x: x["file_path"])).alias("sources"))


def answers(questions: DataFrame, found: DataFrame, model: Model) -> DataFrame:
    """(query_id, answer, sources); an answer that names none of its sources is refused.

    questions(query_id, text); ``model`` maps questions and contexts to answers, a batch
    at a time, on the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["query_id", "sources"]].assign(answer=model(pdf["text"].tolist(), pdf["context"].tolist()))

    rows = questions.join(found, "query_id", "left").select("query_id", "text", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    said = rows.mapInPandas(run, "query_id long, sources array<string>, answer string")
    return said.select("query_id", grounded(F.col("answer"), F.col("sources"), REFUSAL).alias("answer"), "sources")


def capped(files: DataFrame, most: int = 10_000) -> DataFrame:
    """File contents as a reading tool hands them out."""
    return files.select("file_path", F.substring("content", 1, most).alias("content"))
