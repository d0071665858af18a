"""Retrieval quality and operational metrics."""

from __future__ import annotations

import resource
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import evaluation_cost


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall, mrr) of ranked(query_id, rank, id), relevant(query_id, id).

    Precision divides by k even if fewer rows came back; the reciprocal rank looks at all.
    """
    truth = relevant.distinct()
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    flagged = ranked.join(truth.withColumn("_rel", F.lit(True)), ["query_id", "id"], "left").withColumn("_rel", F.coalesce("_rel", F.lit(False)))
    hits = flagged.groupBy("query_id").agg(F.count_if(F.col("_rel") & (F.col("rank") <= k)).alias("hits"), F.min(F.when(F.col("_rel"), F.col("rank"))).alias("first"))
    return hits.join(sizes, "query_id", "left").select("query_id", F.round(F.col("hits") / F.lit(float(k)), 6).alias("precision"), F.round(F.coalesce(F.col("hits") / F.col("n_relevant"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def evaluation_report(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Means of two runs and their differences, one row."""
    mean = lambda df, p: df.agg(*[F.round(F.avg(c), 6).alias(f"{p}{c}") for c in ("precision", "recall", "mrr")])
    both = mean(metrics, "").crossJoin(mean(baseline, "base_"))
    return both.select("*", *[F.round(F.col(c) - F.col(f"base_{c}"), 6).alias(f"delta_{c}") for c in ("precision", "recall", "mrr")])


def latency_stats(events: DataFrame, bucket: str, key: str, ms: str) -> DataFrame:
    return events.groupBy(F.col(bucket).alias("bucket"), F.col(key).alias("key")).agg(F.count(ms).alias("n"), F.round(F.sum(ms), 3).alias("total_ms"), F.round(F.avg(ms), 3).alias("avg_ms"), F.round(F.max(ms), 3).alias("max_ms"))


def error_ratio(events: DataFrame, failed) -> DataFrame:
    n, bad = F.count("*"), F.count_if(failed)
    return events.agg(n.alias("requests"), bad.alias("errors"), F.round(F.when(n > 0, bad / n).otherwise(0.0), 4).alias("ratio"))


def cache_ratio(events: DataFrame, by: str, hit) -> DataFrame:
    n, hits = F.count("*"), F.count_if(hit)
    return events.groupBy(by).agg(hits.alias("hits"), (n - hits).alias("misses"), n.alias("requests"), F.round(F.when(n > 0, hits / n).otherwise(0.0), 4).alias("ratio"))


#: Parts of a key's rows that are cut to the newest ones before they meet.
PARTS = 256


def last_costs(events: DataFrame, by: str, order: tuple[str, ...], cost: str, keep: int = 1000) -> DataFrame:
    """Count, sum, mean and last of the newest ``keep`` costs of each key.

    A key's rows are dealt to ``PARTS`` parts by a hash and each keeps its newest, so that
    one task sees ``keep`` rows a part of a key however many it has.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    newest = [F.desc(c) for c in order]
    some = events.select(by, *order, cost, part.alias("_part"))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*newest))).where(F.col("_n") <= keep)
    kept = some.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*newest))).where(F.col("_n") <= keep)
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("total"), F.round(F.avg(cost), 6).alias("avg"), F.round(F.max_by(cost, -F.col("_n")), 6).alias("last"))


def snapshot_json(*frames: DataFrame) -> DataFrame:
    """Each metric row as one JSON document."""
    out = None
    for df in frames:
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("json"))
        out = rows if out is None else out.union(rows)
    return out


def prometheus_lines(stats: DataFrame, metric: str) -> DataFrame:
    """Latency stats in the text form that scrapers read."""
    label = F.format_string('{bucket="%s",key="%s"}', "bucket", "key")
    parts = [F.concat(F.lit(f"{metric}_{name}"), label, F.lit(" "), F.col(c).cast("string")) for name, c in (("count", "n"), ("sum", "total_ms"), ("max", "max_ms"))]
    return stats.select(F.explode(F.array(*parts)).alias("line"))


def markdown_table(df: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table, to be written below a header line."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


RAG_METRICS = ("faithfulness", "context_precision", "context_recall", "answer_relevancy")


def rag_scores(answers: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """``answers`` with the four RAG metrics of ``scorer``, a function of a batch of rows;
    zeros without one, or for a batch on which it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                found = scorer(pdf)[list(RAG_METRICS)].astype(float)
            except Exception:  # a scorer may fail in any way; its batch scores zero
                found = pd.DataFrame(0.0, index=pdf.index, columns=list(RAG_METRICS))
            yield pdf.assign(**{c: found[c].to_numpy() for c in RAG_METRICS})

    if scorer is None:
        return answers.select("*", *[F.lit(0.0).alias(c) for c in RAG_METRICS])
    schema = StructType([*answers.schema.fields, *[StructField(c, DoubleType()) for c in RAG_METRICS]])
    return answers.mapInPandas(run, schema)


def evaluation_runs(rows: DataFrame, by: str, provider: str) -> DataFrame:
    """One report a ``by``: quality, whole mean latencies, tokens and cost of the answers, the
    same of the baseline's, and the differences.

    rows(by, baseline boolean, precision, recall, mrr, retrieval_ms, llm_ms, tokens and the
    RAG metrics), one a question and run.
    """
    base = F.col("baseline")
    of = lambda c, b: F.when(base if b else ~base, F.col(c))
    mean = lambda c, b=False: F.round(F.coalesce(F.avg(of(c, b)), F.lit(0.0)), 6)
    ms = lambda c, b: F.coalesce(F.floor(F.sum(of(c, b)) / F.count(of(c, b))), F.lit(0)).cast("long")
    total = lambda b: F.coalesce(F.sum(of("tokens", b)), F.lit(0))
    out = rows.groupBy(by).agg(
        F.count_if(~base).alias("sample_count"), *[mean(c).alias(c) for c in ("precision", "recall", "mrr", *RAG_METRICS)],
        ms("retrieval_ms", False).alias("retrieval_ms"), ms("llm_ms", False).alias("llm_ms"), total(False).alias("tokens"), F.count_if(base).alias("baseline_count"),
        *[mean(c, True).alias(f"baseline_{c}") for c in RAG_METRICS], ms("llm_ms", True).alias("baseline_ms"), total(True).alias("baseline_tokens"),
    )
    out = out.withColumn("total_ms", F.col("retrieval_ms") + F.col("llm_ms"))
    out = out.withColumns({"cost": F.round(evaluation_cost(F.lit(provider), "tokens"), 6), "baseline_cost": F.round(evaluation_cost(F.lit(provider), "baseline_tokens"), 6)})
    delta = lambda a, b, n: F.when(F.col("baseline_count") > 0, F.round(F.col(a) - F.col(b), n))
    return out.withColumns({"delta_relevancy": delta("answer_relevancy", "baseline_answer_relevancy", 4), "delta_cost": delta("cost", "baseline_cost", 6), "delta_ms": F.when(F.col("baseline_count") > 0, F.col("llm_ms") - F.col("baseline_ms"))})


# Sections of a report: label, column and its format; those of the last two stand only
# where there is a baseline.
SECTIONS = (
    ("Retrieval", (("Precision@k", "precision", "%.3f"), ("Recall@k", "recall", "%.3f"), ("MRR", "mrr", "%.3f"))),
    ("Answers", (("Faithfulness", "faithfulness", "%.3f"), ("Context precision", "context_precision", "%.3f"), ("Context recall", "context_recall", "%.3f"), ("Relevancy", "answer_relevancy", "%.3f"))),
    ("Latency", (("Retrieval", "retrieval_ms", "%d ms"), ("Model", "llm_ms", "%d ms"), ("Total", "total_ms", "%d ms"))),
    ("Cost", (("Tokens", "tokens", "%d"), ("USD", "cost", "%.4f"))),
    ("Baseline", (("Latency", "baseline_ms", "%d ms"), ("Tokens", "baseline_tokens", "%d"), ("USD", "baseline_cost", "%.4f"))),
    ("Comparison", (("Relevancy", "delta_relevancy", "%.4f"), ("USD", "delta_cost", "%.6f"), ("Latency", "delta_ms", "%d ms"))),
)


def report_markdown(reports: DataFrame, by: str) -> DataFrame:
    """(by, markdown): each report as a Markdown document."""
    head = F.format_string(f"# Evaluation report\n\n- {by}: %s\n- samples: %d", F.col(by), F.col("sample_count"))
    parts = []
    for title, fields in SECTIONS:
        text = F.concat(F.lit(f"## {title}"), *[F.format_string(f"\n- {label}: {form}", F.col(c)) for label, c, form in fields])
        parts.append(text if title not in ("Baseline", "Comparison") else F.when(F.col("baseline_count") > 0, text))
    return reports.select(by, F.concat_ws("\n\n", head, *parts).alias("markdown"))


def acceptance(feedback: DataFrame, by: str, accepted: Column) -> DataFrame:
    n, yes = F.count("*"), F.count_if(accepted)
    return feedback.groupBy(by).agg(n.alias("n"), yes.alias("accepted"), F.round(yes / n, 4).alias("ratio"))


def health_of_ready(repositories: DataFrame) -> DataFrame:
    """How many repositories are ready and their rounded mean health, a missing one being 0."""
    ready = repositories.where("status = 'ready'")
    return ready.agg(F.count("*").alias("ready"), F.coalesce(F.round(F.avg(F.coalesce("health_score", F.lit(0)))), F.lit(0)).cast("long").alias("health"))


def log_lines(records: DataFrame, *extra: str) -> DataFrame:
    """records(ts, level, logger, message, request_id, extra...) as JSON lines without nulls."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    return records.select(F.to_json(F.struct(at, F.lower("level").alias("level"), "logger", "message", "request_id", *extra)).alias("line"))


def peak_memory_mb() -> float:
    """Peak resident memory of this process, for a report's remarks."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
