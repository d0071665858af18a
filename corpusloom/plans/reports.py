"""Queries over index runs, keyed merging, repository notes, starter texts, reports and logs;
they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evaluation, indexing, retrieval, review, rules
from ..sources import repository
from ..sources.storage import load
from .catalog import _match, query
from .fixtures import CODE_CHUNKS_SQL, SHORT_LINES_SQL, code_chunks

_REPO_CHUNKS = f"{SHORT_LINES_SQL}, {CODE_CHUNKS_SQL}, chunks AS (SELECT chunk_id % 97 AS repo, chunk_id, CASE WHEN chunk_id % 197 = 0 THEN 'docs/README.md' WHEN chunk_id % 131 = 0 THEN 'src/tests/a.py' ELSE file_path END AS file_path, chunk_type, symbol_name, language, content FROM code_chunks)"
_ENDPOINT = _match(rules.ENDPOINT, "content")
_UNDOCUMENTED = "chunk_type IN ('function', 'method', 'class') AND NOT CASE WHEN language = 'python' THEN regexp_matches(content, '(?m)^[ \\t]*(''{3}|\"{3})') ELSE regexp_matches(content, '/\\*\\*|//|#') END"
_NO_API = f"{_ENDPOINT} AND NOT (contains(content, 'API') OR contains(lower(content), 'swagger'))"


def _chunks(spark, sf):
    c = F.col("chunk_id")
    path = F.when(c % 197 == 0, "docs/README.md").when(c % 131 == 0, "src/tests/a.py").otherwise(F.col("file_path"))
    return code_chunks(spark, sf).withColumn("file_path", path).withColumn("repo", c % 97)


# ------------------------------------------------------------------------ index runs
_FILES = "files AS (SELECT source, CAST(doc_id AS VARCHAR) AS file_path, sha256(text) AS h, n_chars // 400 AS n_units, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN 'old' END AS old FROM documents)"


def _plan(spark, sf):
    docs = load(spark, sf, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("file_path"), F.sha2("text", 256).alias("content_hash"), F.expr("n_chars div 400").alias("n_units"))
    hashes = docs.where("doc_id % 3 < 2").select("file_path", F.when(F.col("doc_id") % 3 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return indexing.index_plan(docs, hashes)


@query(f"WITH {_FILES} SELECT file_path, CASE WHEN h = old THEN 'unchanged' WHEN n_units = 0 THEN 'empty' ELSE 'indexed' END AS outcome, CAST(CASE WHEN coalesce(h = old, false) THEN 0 ELSE n_units END AS BIGINT) AS n_vectors FROM files")
def index_plan(spark, sf):
    return _plan(spark, sf).select("file_path", "outcome", "n_vectors")


@query(f"WITH {_FILES}, o AS (SELECT source, n_units, NOT coalesce(h = old, false) AND n_units > 0 AS indexed FROM files) SELECT source, count(*) FILTER (indexed) AS files_indexed, count(*) FILTER (NOT indexed) AS files_skipped, CAST(coalesce(sum(n_units) FILTER (indexed), 0) AS BIGINT) AS vectors_indexed FROM o GROUP BY 1")
def index_counters(spark, sf):
    return indexing.index_counters(_plan(spark, sf), "source")


@query("WITH s AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'indexing' WHEN 'purchase' THEN 'ready' ELSE 'error' END AS status, props FROM events WHERE event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, status, CASE WHEN status = 'error' THEN props END AS message FROM s")
def index_status(spark, sf):
    e = F.col("event_type")
    step = F.when(e == "signup", "queued").when(e == "view", "started").when(e == "purchase", "finished").when(e == "error", "failed").otherwise("other")
    steps = load(spark, sf, "events").select("user_id", step.alias("step"), F.col("props").alias("message"), "ts", "event_id")
    return indexing.index_status(steps, "user_id", "ts", "event_id")


@query("WITH last AS (SELECT *, conv_id || ':' || role AS key FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1) SELECT key, CASE WHEN conv_id % 4 = 0 AND role = 'user' THEN 'kept' ELSE '{\"turn\":' || turn || ',\"n\":' || length(text) || '}' END AS value FROM last WHERE conv_id % 10 <> 9")
def agent_memory(spark, sf):
    """Each role's last turn put over an older cache, and a tenth dropped."""
    c = load(spark, sf, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), "role")
    last = c.groupBy("conv_id", "role").agg(F.max(F.struct("turn", "text")).alias("l"))
    rows = last.select("conv_id", "role", key.alias("key"), F.struct(F.col("l.turn").alias("turn"), F.length("l.text").alias("n")).alias("value"))
    old = rows.select("key", F.lit("kept").alias("value"), F.lit(0.0).alias("written_at"), F.lit(3600).alias("ttl"))
    put = indexing.cache_put(old, rows.where("conv_id % 4 <> 0 or role <> 'user'"), 10.0)
    return indexing.cache_drop(put, rows.where("conv_id % 10 = 9")).select("key", "value")


# --------------------------------------------------------------------- keyed merging
_SIDES = """semantic AS (SELECT doc_id % 20 AS query_id, doc_id AS position, CASE doc_id % 3 WHEN 2 THEN source || ':' || (doc_id % 50) ELSE sha256(text) END AS key, n_chars AS score FROM documents WHERE doc_id % 5 <> 0),
    keyword AS (SELECT doc_id % 20 AS query_id, doc_id AS position, CASE doc_id % 3 WHEN 2 THEN source || ':' || (doc_id % 50) ELSE sha256(text) END AS key, n_chars % 97 AS score FROM documents WHERE doc_id % 2 = 0),
    s AS (SELECT query_id, key, arg_max(score, position) AS semantic, count(*) AS n_semantic FROM semantic GROUP BY ALL), k AS (SELECT query_id, key, arg_max(score, position) AS keyword, count(*) AS n_keyword FROM keyword GROUP BY ALL),
    merged AS (SELECT query_id, key, coalesce(semantic, 0) AS semantic, coalesce(keyword, 0) AS keyword, coalesce(n_semantic, 0) AS n_semantic, coalesce(n_keyword, 0) AS n_keyword FROM s FULL JOIN k USING (query_id, key))"""


def _merged(spark, sf):
    docs, d = load(spark, sf, "documents"), F.col("doc_id")
    sha = F.sha2("text", 256)
    rows = docs.select(d, (d % 20).alias("query_id"), d.alias("position"), F.when(d % 3 == 0, sha).otherwise("").alias("sha256"), F.when(d % 3 == 1, sha).alias("content_hash"), F.col("source").alias("file_path"), (d % 50).alias("start_line"), "n_chars")
    keyed = rows.withColumn("key", retrieval.row_key("sha256", "content_hash"))
    semantic = keyed.where("doc_id % 5 <> 0").select("query_id", "position", "key", F.col("n_chars").alias("score"))
    keyword = keyed.where("doc_id % 2 = 0").select("query_id", "position", "key", (F.col("n_chars") % 97).alias("score"))
    return retrieval.merge_keyed(semantic, keyword)


@query(f"WITH {_SIDES} SELECT * FROM merged")
def merge_keyed(spark, sf):
    return _merged(spark, sf)


@query(f"WITH {_SIDES} SELECT query_id, CAST(sum(n_semantic) AS BIGINT) AS semantic_candidates, CAST(sum(n_keyword) AS BIGINT) AS keyword_candidates, count(*) AS merged_candidates, count(*) FILTER (n_semantic > 0 AND n_keyword > 0) AS overlap, round(count(*) FILTER (n_semantic > 0 AND n_keyword > 0) / greatest(count(*) FILTER (n_semantic > 0), 1), 6) AS precision_proxy FROM merged GROUP BY 1")
def merge_metrics(spark, sf):
    return retrieval.merge_metrics(_merged(spark, sf))


@query("SELECT doc_id FROM documents WHERE (doc_id % 4 < 2 OR lang IS NULL OR lang IN ('', 'en')) AND source = (SELECT min(source) FROM documents) AND doc_id % 7 = 3")
def metadata_filter(spark, sf):
    docs, d = load(spark, sf, "documents"), F.col("doc_id")
    least = docs.agg(F.min("source")).first()[0]
    rows = docs.select("doc_id", F.when(d % 4 == 1, "").when(d % 4 > 1, F.col("lang")).alias("language"), F.create_map(F.lit("source"), F.col("source"), F.lit("bucket"), (d % 7).cast("string")).alias("metadata"))
    return rows.where(retrieval.matches("en", {"source": least, "bucket": "3"})).select("doc_id")


# ---------------------------------------------------------- notes and starter texts
@query(f"WITH {_REPO_CHUNKS}, n AS (SELECT repo, count(*) FILTER (contains(file_path, '/tests/') OR starts_with(file_path, 'test_') OR ends_with(file_path, '_test.py') OR contains(lower(file_path), 'spec')) AS tests, count(*) FILTER (chunk_type IN ('function', 'method')) AS functions, count(*) FILTER ({_ENDPOINT}) AS endpoints FROM chunks GROUP BY 1) SELECT repo, 'no_test_suite' AS title, 'high' AS severity FROM n WHERE tests = 0 UNION ALL SELECT repo, 'endpoint_coverage', 'high' FROM n WHERE endpoints > 0 UNION ALL SELECT repo, 'limited_signals', 'low' FROM n WHERE functions = 0 AND endpoints = 0 UNION ALL SELECT repo, 'coverage_targets', 'medium' FROM n WHERE tests > 0 AND endpoints = 0")
def test_notes(spark, sf):
    return rules.test_notes(_chunks(spark, sf), "repo")


_GAPS = f"gaps AS (SELECT repo FROM chunks WHERE {_UNDOCUMENTED} UNION ALL SELECT repo FROM chunks WHERE {_NO_API}), notes AS (SELECT repo, 'missing_readme' AS title, 'high' AS severity FROM chunks GROUP BY 1 HAVING count(*) FILTER (ends_with(lower(file_path), 'readme.md')) = 0 UNION ALL SELECT repo, 'no_gaps', 'low' FROM chunks GROUP BY 1 HAVING count(*) FILTER (ends_with(lower(file_path), 'readme.md')) > 0 AND repo NOT IN (SELECT repo FROM gaps))"


def _doc_findings(spark, sf):
    chunks = _chunks(spark, sf)
    gaps = rules.doc_gaps(chunks).join(chunks.select("chunk_id", "repo"), "chunk_id").select("repo", "title", "severity")
    return chunks, gaps, rules.doc_notes(chunks, gaps, "repo")


@query(f"WITH {_REPO_CHUNKS}, {_GAPS} SELECT * FROM notes")
def doc_notes(spark, sf):
    return _doc_findings(spark, sf)[2]


@query(f"WITH {_REPO_CHUNKS}, {_GAPS}, n AS (SELECT repo, count(*) AS n FROM (SELECT repo FROM gaps UNION ALL SELECT repo FROM notes) GROUP BY 1) SELECT repo, coalesce(n, 0) AS n_findings, CAST(greatest(0, 100 - 5 * coalesce(n, 0)) AS BIGINT) AS score FROM (SELECT DISTINCT repo FROM chunks) LEFT JOIN n USING (repo)")
def doc_score(spark, sf):
    chunks, gaps, notes = _doc_findings(spark, sf)
    return rules.gap_scores(chunks, gaps.union(notes), "repo", 5)


def _filled_sql(text: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for name, value in (("stem", "regexp_replace(string_split(file_path, '/')[-1], '[.][^.]*$', '')"), ("name", "symbol_name"), ("kind", "chunk_type"), ("path", "file_path")):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


@query(f"WITH {_REPO_CHUNKS} " + " UNION ALL ".join(f"SELECT chunk_id, '{kind}' AS kind, {_filled_sql(review.ARTIFACTS[kind][0])} AS path, {_filled_sql(review.ARTIFACTS[kind][1])} AS content FROM chunks WHERE {where}" for kind, where in (("unit_test", "chunk_type IN ('function', 'method')"), ("integration_test", _ENDPOINT), ("docstring", _UNDOCUMENTED), ("api_doc", _NO_API))))
def artifacts(spark, sf):
    chunks = _chunks(spark, sf)
    gaps = F.collect_set("title").alias("gaps")
    found = chunks.join(rules.doc_gaps(chunks).groupBy("chunk_id").agg(gaps), "chunk_id", "left")
    has = lambda title: F.coalesce(F.array_contains("gaps", title), F.lit(False))
    return review.artifacts(found, {"unit_test": F.col("chunk_type").isin("function", "method"), "integration_test": F.col("content").rlike(rules.ENDPOINT), "docstring": has("missing_documentation"), "api_doc": has("missing_api_documentation")})


# ---------------------------------------------------------------- reports and logs
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_RUNS = f"""runs AS (SELECT event_type AS repo, user_id % 2 = 1 AND event_type <> 'view' AS b, event_id % 5 / 5 AS precision, event_id % 7 / 8 AS recall, event_id % 3 / 4 AS mrr, event_id % 300 AS retrieval_ms, event_id % 900 AS llm_ms, {_K} AS tokens, event_id % 11 / 16 AS relevancy FROM events),
    sums AS (SELECT repo, count(*) FILTER (NOT b) AS sample_count, round(avg(precision) FILTER (NOT b), 6) AS precision, round(avg(recall) FILTER (NOT b), 6) AS recall, round(avg(mrr) FILTER (NOT b), 6) AS mrr, round(avg(relevancy) FILTER (NOT b), 6) AS relevancy, CAST(sum(retrieval_ms) FILTER (NOT b) // count(*) FILTER (NOT b) AS BIGINT) AS retrieval_ms, CAST(sum(llm_ms) FILTER (NOT b) // count(*) FILTER (NOT b) AS BIGINT) AS llm_ms, CAST(sum(tokens) FILTER (NOT b) AS BIGINT) AS tokens, count(*) FILTER (b) AS baseline_count, round(coalesce(avg(relevancy) FILTER (b), 0), 6) AS base_relevancy, CAST(coalesce(sum(llm_ms) FILTER (b) // count(*) FILTER (b), 0) AS BIGINT) AS baseline_ms, CAST(coalesce(sum(tokens) FILTER (b), 0) AS BIGINT) AS baseline_tokens FROM runs GROUP BY 1)"""


def _runs(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    base = (u % 2 == 1) & (F.col("event_type") != "view")
    zero = [F.lit(0.0).alias(c) for c in evaluation.RAG_METRICS[:3]]
    rows = load(spark, sf, "events").select(F.col("event_type").alias("repo"), base.alias("baseline"), (e % 5 / 5).alias("precision"), (e % 7 / 8).alias("recall"), (e % 3 / 4).alias("mrr"), (e % 300).alias("retrieval_ms"), (e % 900).alias("llm_ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), *zero, (e % 11 / 16).alias("answer_relevancy"))
    return evaluation.evaluation_runs(rows, "repo", "openai")


@query(f"WITH {_RUNS} SELECT repo, sample_count, precision, recall, mrr, relevancy AS answer_relevancy, retrieval_ms, llm_ms, retrieval_ms + llm_ms AS total_ms, tokens, round(tokens / 1000.0::DOUBLE * 0.00006::DOUBLE, 6) AS cost, baseline_count, base_relevancy AS baseline_answer_relevancy, baseline_ms, baseline_tokens, round(baseline_tokens / 1000.0::DOUBLE * 0.00006::DOUBLE, 6) AS baseline_cost, CASE WHEN baseline_count > 0 THEN round(relevancy - base_relevancy, 4) END AS delta_relevancy, CASE WHEN baseline_count > 0 THEN round(round(tokens / 1000.0::DOUBLE * 0.00006::DOUBLE, 6) - round(baseline_tokens / 1000.0::DOUBLE * 0.00006::DOUBLE, 6), 6) END AS delta_cost, CASE WHEN baseline_count > 0 THEN llm_ms - baseline_ms END AS delta_ms FROM sums")
def evaluation_runs(spark, sf):
    wide = _runs(spark, sf)
    return wide.drop(*[f"{p}{c}" for p in ("", "baseline_") for c in evaluation.RAG_METRICS[:3]])


@query()
def report_markdown(spark, sf):
    """The same reports as documents; a test compares one with its text."""
    return evaluation.report_markdown(_runs(spark, sf), "repo")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS accepted, round(count(*) FILTER (event_type = 'purchase') / count(*), 4) AS ratio FROM events GROUP BY 1")
def feedback_acceptance(spark, sf):
    return evaluation.acceptance(load(spark, sf, "events"), "user_id", F.col("event_type") == "purchase")


@query("SELECT count(*) AS ready, CAST(round(avg(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 101 END)) AS BIGINT) AS health FROM orders WHERE o_orderstatus = 'F'")
def health_of_ready(spark, sf):
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"), F.when(k % 5 != 0, k % 101).alias("health_score"))
    return evaluation.health_of_ready(rows)


@query("SELECT '{\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\",\"level\":\"' || CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END || '\",\"logger\":\"' || event_type || '\",\"message\":\"event ' || event_id || '\"' || CASE WHEN user_id % 3 = 0 THEN '' ELSE ',\"request_id\":\"' || user_id || '\"' END || ',\"tokens\":' || json_extract_string(props, '$.k') || '}' AS line FROM events")
def log_lines(spark, sf):
    e, u = F.col("event_type"), F.col("user_id")
    records = load(spark, sf, "events").select("ts", F.when(e == "error", "ERROR").otherwise("INFO").alias("level"), e.alias("logger"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), F.when(u % 3 != 0, u.cast("string")).alias("request_id"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return evaluation.log_lines(records, "tokens")


@query(f"SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN {_K} WHEN 1 THEN 2 * {_K} WHEN 2 THEN 3 * {_K} ELSE 0 END AS BIGINT) AS reported FROM events")
def token_usage(spark, sf):
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    reply = F.when(e % 4 == 0, F.concat(F.lit('{"usage":{"total_tokens":'), k, F.lit("}}"))).when(e % 4 == 1, F.concat(F.lit('{"usage_metadata":{"input_tokens":'), k, F.lit(',"output_tokens":'), k, F.lit("}}"))).when(e % 4 == 2, F.concat(F.lit('{"response_metadata":{"token_usage":{"prompt_tokens":'), k, F.lit(',"completion_tokens":'), (2 * k.cast("long")).cast("string"), F.lit("}}}"))).otherwise("{}")
    return load(spark, sf, "events").select("event_id", t.token_usage(reply, F.lit("")).cast("long").alias("reported"))


@query("SELECT event_id, CASE WHEN m = 0 THEN '—' WHEN m < 1000 THEN m || 'ms' ELSE (m + 50) // 1000 || '.' || (m + 50) // 100 % 10 || 's' END AS took, CASE event_type WHEN 'error' THEN 'red' WHEN 'view' THEN 'blue' ELSE 'muted' END AS colour FROM (SELECT *, event_id % 2111 AS m FROM events)")
def duration_texts(spark, sf):
    e = F.col("event_type")
    severity = F.when(e == "error", "critical").when(e == "view", "low").otherwise("other")
    return load(spark, sf, "events").select("event_id", t.duration_text(F.col("event_id") % 2111).alias("took"), t.severity_colour(severity).alias("colour"))


@query("SELECT event_id, (epoch_us(lag) - epoch_us(ts)) // 1000 AS ms FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag FROM events) WHERE lag IS NOT NULL")
def request_latency(spark, sf):
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf, "events").select("event_id", "ts", following.alias("next")).where("next is not null").select("event_id", t.latency_ms("ts", "next").alias("ms"))


# ---------------------------------------------------------------------------- paths
_PATH = "regexp_replace(url, '^https?://', '')"


@query(f"WITH p AS (SELECT string_split(CASE WHEN page_id % 9 = 0 THEN '.git/' WHEN page_id % 9 = 1 THEN 'a/build/' ELSE '' END || {_PATH}, '/') AS p FROM pages), c AS (SELECT p, list_position(list_transform(p, lambda x: x IN ('.git', 'build')), true) AS hidden FROM p), l AS (SELECT p, unnest(generate_series(1, least(CASE WHEN hidden > 0 THEN hidden - 1 ELSE len(p) END, 3))) AS level FROM c) SELECT DISTINCT array_to_string(p[1:level - 1], '/') AS parent, p[level] AS name, CAST(level AS INT) AS level, CASE WHEN level > 2 THEN 'truncated' WHEN level = len(p) THEN 'file' ELSE 'directory' END AS kind FROM l")
def folder_tree(spark, sf):
    head = F.when(F.col("page_id") % 9 == 0, ".git/").when(F.col("page_id") % 9 == 1, "a/build/").otherwise("")
    paths = load(spark, sf, "pages").select(F.concat(head, F.regexp_replace("url", "^https?://", "")).alias("path"))
    return repository.folder_tree(paths, 2)


_SUFFIXES = (".py", ".TSX", ".jsx", ".md", ".c", "")


@query(f"WITH p AS (SELECT CASE page_id % 5 WHEN 0 THEN 'dist/' WHEN 1 THEN '.hidden/' ELSE 'src/' END AS folder, page_id % {len(_SUFFIXES)} AS s FROM pages) SELECT CASE s WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 3 THEN 'Markdown' ELSE 'C++' END AS language, count(*) AS n FROM p WHERE folder = 'src/' AND s IN (0, 1, 3, 4) GROUP BY 1")
def index_languages(spark, sf):
    i = F.col("page_id")
    folder = F.when(i % 5 == 0, "dist/").when(i % 5 == 1, ".hidden/").otherwise("src/")
    path = F.concat(folder, F.lit("f"), i.cast("string"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (i % len(_SUFFIXES) + 1).cast("int")))
    return load(spark, sf, "pages").select(t.index_language(path).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
