"""Review planning, agent results, summaries and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import effort_bucket, first_nonzero, strip_fence

# Agents by review type, in order, and the order in which stages run.
PLANS = {
    "full": ("repository", "security", "architecture", "performance", "testing", "documentation", "dependencies"),
    "security": ("repository", "security", "dependencies"),
    "performance": ("repository", "performance", "architecture"),
    "testing": ("repository", "testing"),
    "documentation": ("repository", "documentation"),
    "architecture": ("repository", "architecture"),
    "style": ("repository", "style"),
    "dependencies": ("repository", "dependencies", "security"),
}
STAGES = ("repository", "security", "architecture", "performance", "testing", "documentation", "dependencies", "summary")
FINDING = "struct<severity:string,category:string,title:string,description:string,file_path:string,line_number:int,suggestion:string>"
REPLY = f"struct<score:int,findings:array<{FINDING}>,summary:string>"


def plan_agents(requests: DataFrame) -> DataFrame:
    """requests(review_type, focus) with ``agents``; an unknown type gets the full plan."""
    spark = requests.sparkSession
    plans = spark.createDataFrame([(k, list(v)) for k, v in PLANS.items()], "review_type string, _plan array<string>")
    full = F.array(*map(F.lit, PLANS["full"]))
    planned = requests.join(F.broadcast(plans), "review_type", "left")
    base = F.coalesce("_plan", full)
    focused = F.when(F.size(F.coalesce("focus", F.array().cast("array<string>"))) > 0, F.filter(base, lambda a: F.array_contains("focus", a) | (a == "repository"))).otherwise(base)
    return planned.select(*requests.columns, F.concat(focused, F.array(F.lit("summary"))).alias("agents"))


def checked_plan(plans: DataFrame) -> DataFrame:
    """plans(plan_id, agents array<struct<name, priority>>): known names by falling priority."""
    known = F.filter("agents", lambda a: a["name"].isin(*STAGES))
    order = F.transform(known, lambda a, i: F.struct((-F.coalesce(a["priority"], F.lit(5))).alias("p"), i.alias("i"), a["name"].alias("name")))
    return plans.select("plan_id", F.transform(F.array_sort(order), lambda x: x["name"]).alias("agents"))


def next_stage(states: DataFrame) -> DataFrame:
    """states(plan_id, agents, current) with the next planned stage, or end."""
    stages = F.array(*map(F.lit, STAGES))
    at = F.coalesce(F.array_position(stages, F.col("current")), F.lit(0))
    later = F.filter(stages, lambda s, i: (i + 1 > at) & F.array_contains("agents", s))
    return states.select("*", F.coalesce(F.get(later, F.lit(0)), F.lit("end")).alias("next"))


def parse_replies(replies: DataFrame, text_column: str = "reply") -> DataFrame:
    """Adds ``parsed``; text that is no JSON becomes a summary of 500 characters, score 50."""
    parsed = F.from_json(strip_fence(text_column), REPLY)
    fallback = F.struct(F.lit(50).alias("score"), F.array().cast(f"array<{FINDING}>").alias("findings"), F.substring(text_column, 1, 500).alias("summary"))
    ok = parsed.isNotNull() & (parsed["score"].isNotNull() | parsed["summary"].isNotNull() | parsed["findings"].isNotNull())
    return replies.withColumn("parsed", F.when(ok, parsed).otherwise(fallback.cast(REPLY)))


def normal_findings(findings: Column, agent: Column) -> Column:
    """Findings with defaults for severity, category and title."""
    return F.transform(findings, lambda f: F.struct(F.coalesce(f["severity"], F.lit("info")).alias("severity"), F.coalesce(f["category"], agent).alias("category"), F.coalesce(f["title"], F.lit("Finding")).alias("title")))


def token_totals(results: DataFrame) -> DataFrame:
    """results(review_id, step, tokens) with the running total of each review."""
    upto = Window.partitionBy("review_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("total_tokens", F.sum("tokens").over(upto))


def summaries(results: DataFrame) -> DataFrame:
    """(review_id, overall, effort) of results(review_id, agent, score, n_critical, n_high, n_findings).

    The overall score is the floored mean of the scores that exist, else 50.
    """
    scored = results.where("agent <> 'progress'").groupBy("review_id").agg(F.sum("score").alias("s"), F.count("score").alias("n"), F.sum("n_critical").alias("c"), F.sum("n_high").alias("h"), F.sum("n_findings").alias("t"))
    overall = F.when(F.col("n") > 0, F.expr("s div n")).otherwise(F.lit(50))
    return scored.select("review_id", overall.cast("long").alias("overall"), effort_bucket(F.col("c"), F.col("h"), F.col("t")).alias("effort"))


def normal_summary(summary_score: Column, fallback_score: Column) -> Column:
    """A summary's score, replaced where it is missing or zero."""
    return first_nonzero(summary_score, fallback_score)


def reports(results: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """One wide row a review: the score of each agent of a fixed list."""
    return results.groupBy("review_id").pivot("agent", list(agents)).agg(F.max("score"))


def details(reviews: DataFrame, logs: DataFrame, wide: DataFrame) -> DataFrame:
    """Reviews with counts of their log rows and their report's scores."""
    counts = logs.where("agent <> 'progress'").groupBy("review_id").agg(F.count("*").alias("n_agents"))
    return reviews.join(counts, "review_id", "left").join(wide, "review_id", "left").fillna(0, ["n_agents"])


def score_rows(wide: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """A wide report turned into (review_id, metric, score) rows."""
    return wide.unpivot(["review_id"], list(agents), "metric", "score").where("score is not null")


def history_page(reviews: DataFrame, order: str, tie: str, offset: int, limit: int) -> DataFrame:
    """One page, newest first."""
    return reviews.orderBy(F.desc(order), F.asc(tie)).offset(offset).limit(limit)


def latest_scores(reviews: DataFrame, repositories: DataFrame, default: int = 70) -> DataFrame:
    """(repository_id, overall) of each repository's last completed review, else a default."""
    done = reviews.where("status = 'completed'")
    last = done.groupBy("repository_id").agg(F.max_by("overall", F.struct("completed_at", "review_id")).alias("overall"))
    return repositories.select("repository_id").join(last, "repository_id", "left").select("repository_id", first_nonzero(F.col("overall"), F.lit(default)).cast("long").alias("overall"))


def test_plan(languages: list[str], used: list[str]) -> str:
    """A starter test plan."""
    head = ["# Test Plan", "", "Cover core logic with unit tests and request flows with integration tests.", ""]
    return "\n".join(head + [f"Frameworks: {', '.join(used)}"] * bool(used) + [f"Languages: {', '.join(languages)}"] * bool(languages) + ["", "- tests/unit/", "- tests/integration/", "- tests/data/"])


def run_review(spark: SparkSession, review_type: str, agents: dict, focus: list[str] | None = None, progress=None) -> DataFrame:
    """Run the planned agents, each a callable giving (agent, score, ...) rows, and unite them."""
    plan = plan_agents(spark.createDataFrame([(review_type, focus)], "review_type string, focus array<string>")).first()["agents"]
    out = None
    for name in STAGES:
        if name in plan and name in agents:
            rows = agents[name]()
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
            if progress:
                progress(name)
    return out


# Starter texts by kind: the path they belong to and what they hold.
ARTIFACTS = {
    "unit_test": ("tests/test_{stem}.py", "from {stem} import {name}\n\n\ndef test_{name}():\n    assert {name} is not None  # to be replaced by real cases\n"),
    "integration_test": ("tests/test_{stem}_integration.py", "# Covers the endpoint of {path}: request, response, failure.\n\n\ndef test_{stem}_request():\n    pass\n"),
    "docstring": ("{path}", "{name}: what this {kind} does.\n\nParameters: none described yet.\nReturns: not described yet.\n"),
    "api_doc": ("API.md", "### {name}\n\nMethod and path, request body and response body of the endpoint in {path}.\n"),
}


def artifacts(chunks: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """(chunk_id, kind, path, content): a starter text for each kind whose condition a chunk
    meets. A chunk without a symbol is named by its kind of text."""
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.coalesce(F.nullif(F.col("symbol_name"), F.lit("")), F.lit("symbol"))
    values = {"stem": stem, "name": name, "kind": F.col("chunk_type"), "path": F.col("file_path")}

    def filled(text: str) -> Column:
        parts = re.split(r"\{(\w+)\}", text)
        return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    rows = [F.when(test, F.struct(F.lit(kind).alias("kind"), filled(ARTIFACTS[kind][0]).alias("path"), filled(ARTIFACTS[kind][1]).alias("content"))) for kind, test in wanted.items()]
    return chunks.select("chunk_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("a")).select("chunk_id", "a.*")


def readme(title: str, languages: list[str], used: list[str], install: dict[str, str]) -> str:
    """A starter README; ``install`` has a command by language."""
    lines = [f"# {title}", ""]
    for name, items in (("Languages", languages), ("Frameworks", used)):
        lines += [f"{name}: {', '.join(items)}", ""] * bool(items)
    commands = dict.fromkeys(install[x] for x in languages if x in install)
    return "\n".join([*lines, "## Setup", "", *(f"    {c}" for c in commands), "", "## Use", "", "## How to contribute", ""])
