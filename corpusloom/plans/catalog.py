"""Named queries over the driver's tables, and DuckDB SQL with the same result for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evaluation, graph, indexing, retrieval, review, rules, similarity
from ..sources import repository
from ..sources.storage import load
from .fixtures import CODE_CHUNKS_SQL, CODE_LINES_SQL, SHORT_LINES_SQL, code_chunks, code_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ text and files
@query(f"SELECT lang, CAST(sum(len({WORDS})) AS BIGINT) AS n_tokens, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines, count(*) AS n_docs FROM documents GROUP BY lang")
def tokenize_stats(spark, sf):
    return load(spark, sf, "documents").groupBy("lang").agg(F.sum(F.size(t.tokens("text"))).alias("n_tokens"), F.sum(t.line_count("text").cast("long")).alias("n_lines"), F.count("*").alias("n_docs"))


@query(f"SELECT sha256({STRIPPED}) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf):
    return load(spark, sf, "documents").groupBy(t.content_hash("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"SELECT doc_id, substr(text, 1, 500) AS preview FROM documents WHERE length({STRIPPED}) > 0 AND NOT (length({STRIPPED}) < 10 AND starts_with({STRIPPED}, '#'))")
def chunk_filter(spark, sf):
    return load(spark, sf, "documents").where(t.indexable_chunk("text")).select("doc_id", F.substring("text", 1, 500).alias("preview"))


_FILES = ("src/App.PY", "web/main.tsx", "node_modules/a/b.js", "lib/x.min.js", "go.mod", "poetry.lock", "docs/readme", ".gitignore", "a.b/c.java", "pkg/style.map", "core/vec.hpp", "package.json", "main.rs")
_PATHS = f"SELECT page_id, regexp_extract(coalesce(url, ''), '^https?://[^/]+/([^?#]*)', 1) || '/' || CASE page_id % {len(_FILES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FILES)) + " END AS path FROM pages"
_EXT = "lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1))"


@query(
    f"SELECT page_id, path, CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.LANGUAGES.items()) + f" END AS language, "
    f"(len(list_intersect(string_split(path, '/'), [{', '.join(repr(d) for d in t.IGNORED_DIRS)}])) > 0 OR list_contains([{', '.join(repr(d) for d in t.IGNORED_FILES)}], string_split(path, '/')[-1]) OR regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1) IN ('.map', '.lock')) AS ignored, "
    f"list_contains([{', '.join(repr(d) for d in t.DEPENDENCY_FILES)}], string_split(path, '/')[-1]) AS manifest FROM ({_PATHS})"
)
def language_map(spark, sf):
    """Files below the path of each page."""
    file = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("page_id") % len(_FILES) + 1).cast("int"))
    folder = F.regexp_extract(F.coalesce("url", F.lit("")), "^https?://[^/]+/([^?#]*)", 1)
    paths = load(spark, sf, "pages").select("page_id", F.concat(folder, F.lit("/"), file).alias("path"))
    return paths.select("page_id", "path", t.language_of("path").alias("language"), t.ignored_path("path").alias("ignored"), t.is_dependency_file(t.file_name("path")).alias("manifest"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS owner, regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS name FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[a-z]+/[0-9]+')")
def url_parse(spark, sf):
    u = F.col("url")
    pages = load(spark, sf, "pages").where(u.rlike("^https?://[^/]+/[a-z]+/[0-9]+"))
    path = F.regexp_replace(u, "[?#].*$", "")
    parsed = t.parse_repo_url(F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "://www[.]", "://www-"), r"[^/]+")
    return pages.select("page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.regexp_extract(u, "^https?://([^/]+)/", 1).alias("host"), parsed["owner"].alias("owner"), F.regexp_extract(parsed["name"], "^([0-9]+)", 1).alias("name"))


@query("SELECT p_partkey, k AS framework FROM part JOIN (VALUES ('ring'), ('bolt'), ('gear'), ('red'), ('small')) AS f(k) ON contains(lower(p_name), k)")
def framework_detect(spark, sf):
    name = F.lower("p_name")
    hits = F.filter(F.array(*[F.when(F.contains(name, F.lit(k)), F.lit(k)) for k in ("ring", "bolt", "gear", "red", "small")]), lambda x: x.isNotNull())
    return load(spark, sf, "part").select("p_partkey", F.explode(hits).alias("framework"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, 'Repository with ' || lang || ' (' || CAST(count(*) AS VARCHAR) || ').' AS overview FROM documents GROUP BY lang")
def language_overview(spark, sf):
    counts = load(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", "n", t.overview(F.create_map("lang", "n"), F.array().cast("array<string>")).alias("overview"))


# ------------------------------------------------------------------------ retrieval
def _text_queries(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vector_queries(spark, sf):
    items = load(spark, sf, "benchmark").select("item_id")
    return load(spark, sf, "embeddings").join(items, F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")


def _every_20th(spark, sf):
    """The query set of a search: every row whose id is divisible by 20."""
    return load(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vector_sql(where: str, k: int, asked: str = "q.vec_id IN (SELECT item_id FROM benchmark)") -> str:
    cosine = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
    return f"scored AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {cosine} AS score FROM embeddings v, embeddings q WHERE {asked} {where}), semantic AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM scored QUALIFY rank <= {k})"


def _bm25_sql(where: str, k: int) -> str:
    return f"""docs AS (SELECT doc_id AS id, {WORDS} AS words FROM documents {where}),
    stats AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM docs),
    asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
    tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    matched AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 6) AS score FROM tf JOIN asked USING (term) JOIN dfs USING (term), stats GROUP BY query_id, id),
    filled AS (SELECT b.item_id AS query_id, d.id, coalesce(m.score, 0) AS score FROM benchmark b CROSS JOIN docs d LEFT JOIN matched m ON m.query_id = b.item_id AND m.id = d.id),
    keyword AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM filled QUALIFY rank <= {k})"""


@query(f"WITH {_bm25_sql('', 10)} SELECT * FROM keyword")
def bm25_topk(spark, sf):
    return retrieval.bm25_topk(load(spark, sf, "documents"), _text_queries(spark, sf), 10)


@query(f"WITH {_bm25_sql("WHERE lang = 'en'", 10)} SELECT * FROM keyword")
def bm25_topk_filtered(spark, sf):
    lang = F.col("lang")
    return retrieval.bm25_topk(load(spark, sf, "documents").where(lang.isNull() | (lang == "") | (lang == "en")), _text_queries(spark, sf), 10)


@query(f"WITH {_vector_sql('', 10, 'q.vec_id % 20 = 0')} SELECT * FROM semantic")
def vector_topk(spark, sf):
    return retrieval.vector_topk(load(spark, sf, "embeddings"), _every_20th(spark, sf), 10)


@query(f"WITH {_vector_sql('AND v.label IN (1, 2, 3)', 10, 'q.vec_id % 20 = 0')} SELECT * FROM semantic")
def vector_topk_filtered(spark, sf):
    return retrieval.vector_topk(load(spark, sf, "embeddings").where(F.col("label").isin(1, 2, 3)), _every_20th(spark, sf), 10)


_MERGED = "merged AS (SELECT coalesce(s.query_id, w.query_id) AS query_id, coalesce(s.id, w.id) AS id, coalesce(s.score, 0) AS semantic, coalesce(w.score, 0) AS keyword, s.id IS NOT NULL AS in_s, w.id IS NOT NULL AS in_k FROM semantic s FULL JOIN keyword w ON s.query_id = w.query_id AND s.id = w.id)"


@query(
    f"""WITH {_vector_sql('', 250)}, {_bm25_sql('', 500)}, {_MERGED},
    tops AS (SELECT query_id, max(semantic) AS ts, max(keyword) AS tk FROM merged GROUP BY query_id),
    q AS (SELECT item_id AS query_id, list_distinct({WORDS}) AS asked FROM benchmark),
    scores AS (SELECT m.query_id, m.id, semantic, keyword, round(0.7::DOUBLE * CASE WHEN ts > 0 THEN semantic / ts ELSE 0 END + 0.3::DOUBLE * CASE WHEN tk > 0 THEN keyword / tk ELSE 0 END + 0.05::DOUBLE * len(list_intersect(asked, list_distinct(words))) / greatest(len(asked), 1), 6) AS score FROM merged m JOIN tops USING (query_id) JOIN q USING (query_id) JOIN docs USING (id))
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM scores QUALIFY rank <= 50"""
)
def hybrid_topk(spark, sf):
    return retrieval.hybrid_topk(load(spark, sf, "documents"), load(spark, sf, "embeddings"), _text_queries(spark, sf), _vector_queries(spark, sf), 50)


@query(f"WITH {_vector_sql('', 250)}, {_bm25_sql('', 500)}, {_MERGED} SELECT query_id, count(*) FILTER (in_s AND in_k) AS overlap, round(count(*) FILTER (in_s AND in_k) / greatest(count(*) FILTER (in_s), 1), 6) AS proxy FROM merged GROUP BY query_id")
def hybrid_overlap(spark, sf):
    semantic = retrieval.vector_topk(load(spark, sf, "embeddings"), _vector_queries(spark, sf), 250)
    keyword = retrieval.bm25_topk(load(spark, sf, "documents"), _text_queries(spark, sf), 500)
    return retrieval.overlap(retrieval.merge_candidates(semantic, keyword))


@query(f"WITH {_bm25_sql('', 5)}, near AS (SELECT query_id % 7 AS agent, query_id AS query_no, rank, id FROM keyword), firsts AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY agent, id ORDER BY query_no, rank) = 1) SELECT agent, query_no, rank, id, CAST(row_number() OVER (PARTITION BY agent ORDER BY query_no, rank) AS INT) AS position FROM firsts QUALIFY position <= 15")
def multi_query_dedup(spark, sf):
    ranked = retrieval.bm25_topk(load(spark, sf, "documents"), _text_queries(spark, sf), 5)
    rows = ranked.select((F.col("query_id") % 7).alias("agent"), F.col("query_id").alias("query_no"), "rank", F.col("id").alias("key"))
    return retrieval.multi_query(rows).withColumnRenamed("key", "id")


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM conversations QUALIFY running <= 4000")
def context_budget(spark, sf):
    return retrieval.context_budget(load(spark, sf, "conversations"), "conv_id", ("turn",)).select("conv_id", "turn", "running")


@query("SELECT conv_id, turn, role, 'File: conv/' || CAST(conv_id AS VARCHAR) || ' | Symbol: ' || role || ' | Lines: ' || CAST(turn AS VARCHAR) || '-' || CAST(turn + 1 AS VARCHAR) || chr(10) || '```' || chr(10) || substr(text, 1, 2000) || chr(10) || '```' AS block, CASE WHEN contains(text, 'the') THEN text ELSE 'I cannot answer from the given sources.' END AS answer FROM conversations WHERE role IN ('user', 'assistant')")
def conversation_sources(spark, sf):
    c = load(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    block = t.context_block(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), F.col("role"), F.col("turn"), F.col("turn") + 1, F.col("text"))
    return c.select("conv_id", "turn", "role", block.alias("block"), t.grounded(F.col("text"), F.array(F.lit("the")), "I cannot answer from the given sources.").alias("answer"))


# ----------------------------------------------------------------------- line rules
_LINES = "lines AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chunk_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), unnest(string_split(html, chr(10))) FROM pages)"
_SECRET = "(" + " OR ".join(f"contains(lower(trim(line)), '{n}')" for n in rules.SECRET_NAMES) + ") AND (contains(line, '=') OR contains(line, ':')) AND NOT regexp_matches(line, '[''\"]{3}.*[''\"]{3}') AND regexp_matches(line, '[\"''`].+?[\"''`]')"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _match(pattern: str, column: str = "line") -> str:
    return f"regexp_matches({column}, {_sql(pattern)})"


def _raw_lines(spark, sf):
    docs = load(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    pages = load(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_id"), F.col("html").alias("text"))
    return rules.lines_of(docs.union(pages), "chunk_id")


@query(f"WITH {_LINES} SELECT chunk_id, line FROM lines WHERE {_SECRET}")
def secret_scan(spark, sf):
    return _raw_lines(spark, sf).where(rules.secret_line(F.col("line"))).select("chunk_id", "line")


@query(f"WITH {_LINES}, hits AS (SELECT chunk_id, count(*) AS n FROM lines WHERE {_SECRET} GROUP BY 1), chunks AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chunk_id FROM documents UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR) FROM pages) SELECT chunk_id, coalesce(n, 0) AS n_findings, CAST(CASE WHEN n IS NULL THEN 95 ELSE greatest(0, 100 - 30 * n) END AS BIGINT) AS score, CASE WHEN n IS NULL THEN 'none' ELSE CAST(n AS VARCHAR) || ' critical' END AS summary FROM chunks LEFT JOIN hits USING (chunk_id)")
def secret_score(spark, sf):
    lines = _raw_lines(spark, sf)
    found = lines.where(rules.secret_line(F.col("line"))).select("chunk_id", "line_no", F.lit(1).alias("rule_order"), F.lit("critical").alias("severity"))
    docs = load(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"))
    pages = load(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_id"))
    return rules.security_scores(docs.union(pages), found)


_NEAR = "OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)"
_HAS = lambda names: "(" + " OR ".join(f"contains(line, '{n}')" for n in names) + ")"
_RULES = [
    (1, "hardcoded_secret", "critical", 0.95, _SECRET),
    (2, "sql_injection", "critical", 0.9, f"{_match(rules.DB_CALL)} AND {_match(rules.DB_MIXED)}"),
    (2, "sql_injection_risk", "high", 0.85, f"NOT ({_match(rules.DB_CALL)} AND {_match(rules.DB_MIXED)}) AND {_match(rules.SELECT_FROM)} AND {_match(rules.SELECT_MIXED)}"),
    (3, "command_injection", "critical", 0.9, f"{_match(rules.PROCESS_CALL)} AND {_match(rules.PROCESS_MIXED)}"),
    (4, "dynamic_code", "high", 0.85, _match(rules.DYNAMIC_CODE)),
    (5, "jwt_unverified", "critical", 0.95, "contains(line, 'jwt.decode') AND contains(line, 'verify=False')"),
    (5, "jwt_algorithms", "high", 0.8, "contains(line, 'jwt.decode') AND NOT contains(line, 'verify=False') AND NOT contains(line, 'algorithms')"),
    (6, "missing_authentication", "high", 0.8, f"{_match(rules.ROUTE)} AND NOT authenticated"),
    (7, "missing_authorization", "medium", 0.7, f"{_match(rules.ROLE_CHECK)} AND NOT authorised"),
    (8, "xss", "high", 0.85, _match(rules.SCRIPT_SINK)),
    (9, "csrf", "high", 0.85, "contains(line, 'csrf_exempt') OR (contains(line, 'CSRF') AND contains(line, 'disabled'))"),
    (10, "prompt_injection", "high", 0.8, f"{_match(rules.PROMPT)} AND {_match(rules.INTERPOLATED)}"),
]
_FINDINGS = (
    f"near AS (SELECT *, bool_or({_HAS(rules.AUTHENTICATED)}) {_NEAR} AS authenticated, bool_or({_HAS(rules.AUTHORISED)}) {_NEAR} AS authorised FROM code_lines), findings AS ("
    + " UNION ALL ".join(f"SELECT chunk_id, line_no, {o} AS rule_order, '{r}' AS rule, '{s}' AS severity, CAST({c} AS DOUBLE) AS confidence FROM near WHERE {w}" for o, r, s, c, w in _RULES)
    + ")"
)
_SECURITY = f"{CODE_LINES_SQL}, {_FINDINGS}"


@query(f"WITH {_SECURITY} SELECT * FROM findings")
def security_findings(spark, sf):
    return rules.security_findings(code_lines(spark, sf))


_WEIGHT = "CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 WHEN 'low' THEN 5 WHEN 'info' THEN 2 ELSE 10 END"


@query(f"WITH {SHORT_LINES_SQL}, {_FINDINGS}, sums AS (SELECT chunk_id, count(*) AS n, sum({_WEIGHT}) AS w FROM findings GROUP BY 1), seen AS (SELECT chunk_id, severity, count(*) AS n, min(rule_order * 1000000 + line_no) AS place FROM findings GROUP BY ALL), said AS (SELECT chunk_id, string_agg(CAST(n AS VARCHAR) || ' ' || severity, ', ' ORDER BY place) AS summary FROM seen GROUP BY 1) SELECT c.chunk_id, coalesce(n, 0) AS n_findings, CAST(CASE WHEN n IS NULL THEN 95 ELSE greatest(0, 100 - w) END AS BIGINT) AS score, coalesce(summary, 'none') AS summary FROM (SELECT DISTINCT chunk_id FROM code_lines) c LEFT JOIN sums USING (chunk_id) LEFT JOIN said USING (chunk_id)")
def security_score(spark, sf):
    lines = code_lines(spark, sf, "l_orderkey")
    return rules.security_scores(lines, rules.security_findings(lines))


@query(f"WITH {CODE_LINES_SQL} SELECT chunk_id, line_no FROM (SELECT *, bool_or({_HAS(rules.AUTHENTICATED)}) {_NEAR} AS authenticated FROM code_lines) WHERE {_match(rules.ROUTE)} AND NOT authenticated")
def auth_guard_window(spark, sf):
    return rules.security_findings(code_lines(spark, sf)).where("rule = 'missing_authentication'").select("chunk_id", "line_no")


_FRAME = "OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN {} AND {})"
_SLOW = f"""flags AS (SELECT *, {_match(rules.LOOP)} AS is_loop, {_match(rules.DB_FETCH)} AS db, {_match('for |while')} AS has_for, {_match(rules.SCOPE)} AS has_scope, CASE WHEN {_match(rules.LOOP_END)} THEN line_no END AS stop FROM code_lines),
    marked AS (SELECT *, bool_or({_match(rules.ASYNC)}) OVER (PARTITION BY chunk_id) AS in_async, bool_or({_match(rules.MEMOISED)}) OVER (PARTITION BY chunk_id) AS memo, bool_or(db) {_FRAME.format('CURRENT ROW', '7 FOLLOWING')} AS db_near, coalesce(bool_or(is_loop) {_FRAME.format('1 FOLLOWING', '19 FOLLOWING')}, false) AS inner_loop, bool_or(has_for) {_FRAME.format('2 PRECEDING', '3 FOLLOWING')} AS for_near, bool_or(has_scope) {_FRAME.format('4 PRECEDING', '5 FOLLOWING')} AS scope_near, coalesce(min(stop) {_FRAME.format('1 FOLLOWING', '200 FOLLOWING')} - line_no - 1, count(line_no) {_FRAME.format('1 FOLLOWING', '200 FOLLOWING')}) AS body FROM flags),
    findings AS (SELECT chunk_id, CAST(line_no AS BIGINT) AS line_no, 'n_plus_one' AS rule, 'high' AS severity FROM marked WHERE is_loop AND db_near
    UNION ALL SELECT chunk_id, line_no, 'blocking_io', 'medium' FROM marked WHERE in_async AND {_match(rules.BLOCKING)} AND NOT contains(line, 'await')
    UNION ALL SELECT chunk_id, line_no, 'large_loops', 'medium' FROM marked WHERE is_loop AND body > 100
    UNION ALL SELECT chunk_id, line_no, 'inefficient_algorithms', 'high' FROM marked WHERE is_loop AND inner_loop
    UNION ALL SELECT chunk_id, line_no, 'redundant_allocations', 'low' FROM marked WHERE {_match(rules.ALLOCATION)} AND for_near
    UNION ALL SELECT chunk_id, line_no, 'memory_leaks', 'medium' FROM marked WHERE {_match(rules.MUTATION)} AND NOT scope_near
    UNION ALL SELECT chunk_id, 1, 'recursive_bottlenecks', 'high' FROM marked WHERE {_match(rules.FUNCTION)} AND NOT memo)"""
_PERFORMANCE = f"{CODE_LINES_SQL}, {_SLOW}"


@query(f"WITH {_PERFORMANCE} SELECT * FROM findings")
def window_rules(spark, sf):
    return rules.performance_findings(code_lines(spark, sf))


@query(f"WITH {SHORT_LINES_SQL}, {_SLOW}, sums AS (SELECT chunk_id, count(*) AS n, count(*) FILTER (rule = 'n_plus_one') AS a, count(*) FILTER (rule = 'inefficient_algorithms') AS b, count(*) FILTER (rule = 'blocking_io') AS c FROM findings GROUP BY 1) SELECT k.chunk_id, coalesce(n, 0) AS n_findings, greatest(0, 100 - coalesce(a, 0) * 10 - coalesce(b, 0) * 8 - coalesce(c, 0) * 5) AS score FROM (SELECT DISTINCT chunk_id FROM code_lines) k LEFT JOIN sums USING (chunk_id)")
def performance_score(spark, sf):
    lines = code_lines(spark, sf, "l_orderkey")
    return rules.performance_scores(lines, rules.performance_findings(lines))


_ARCH = f"""{CODE_LINES_SQL}, f AS (SELECT *, {_match(rules.CLASS)} AS is_class, {_match(rules.TOP_FUNCTION)} AS is_function, CASE WHEN {_match(rules.FUNCTION_END)} THEN line_no END AS stop FROM code_lines),
    m AS (SELECT *, bool_or(is_class) {_FRAME.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS in_class, coalesce(min(stop) {_FRAME.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} - line_no - 1, count(line_no) {_FRAME.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')}) AS size FROM f),
    metrics AS (SELECT chunk_id, count(*) AS num_lines, count(*) FILTER (is_class) AS num_classes, count(*) FILTER (is_function) AS num_functions, round(coalesce(avg(size) FILTER (is_function), 0), 6) AS avg_function_length, round(CASE WHEN count(*) FILTER (is_class) > 0 THEN count(*) FILTER (in_class AND {_match(rules.METHOD)}) / count(*) FILTER (is_class) ELSE 0 END, 6) AS avg_methods_per_class, count(*) FILTER ({_match(rules.IMPORT)}) AS num_imports, count(*) FILTER ({_match(rules.TYPE_CHECK)}) AS type_checks FROM m GROUP BY chunk_id),
    arch AS (SELECT chunk_id, 'large_classes' AS title, 'high' AS severity FROM metrics WHERE num_classes > 0 AND avg_methods_per_class > 12 UNION ALL SELECT chunk_id, 'large_functions', 'high' FROM metrics WHERE avg_function_length > 120 UNION ALL SELECT chunk_id, 'open_closed', 'medium' FROM metrics WHERE type_checks > 4 UNION ALL SELECT chunk_id, 'high_coupling', 'medium' FROM metrics WHERE num_imports > 15)"""


@query(f"WITH {_ARCH} SELECT * FROM metrics")
def arch_metrics(spark, sf):
    return rules.architecture_metrics(code_lines(spark, sf))


@query(f"WITH {_ARCH} SELECT * FROM arch")
def arch_findings(spark, sf):
    return rules.architecture_findings(rules.architecture_metrics(code_lines(spark, sf)))


@query(f"WITH {_ARCH}, lost AS (SELECT chunk_id, sum(CASE severity WHEN 'high' THEN 20 ELSE 10 END) AS lost FROM arch GROUP BY 1) SELECT chunk_id, CAST(greatest(0, 100 - coalesce(lost, 0) - CASE WHEN num_imports > 20 THEN 5 ELSE 0 END - CASE WHEN num_lines > 2000 THEN 10 ELSE 0 END) AS BIGINT) AS score, avg_function_length < 30 AND num_imports < 5 AS strength FROM metrics LEFT JOIN lost USING (chunk_id)")
def arch_score(spark, sf):
    metrics = rules.architecture_metrics(code_lines(spark, sf))
    return rules.architecture_scores(metrics, rules.architecture_findings(metrics))


@query(f"WITH {_ARCH} SELECT priority, action FROM (VALUES ('large_classes', 'P1', 'split classes'), ('large_functions', 'P2', 'split functions')) AS w(title, priority, action) WHERE title IN (SELECT title FROM arch) UNION ALL SELECT 'P3', 'document modules'")
def arch_roadmap(spark, sf):
    return rules.roadmap(rules.architecture_findings(rules.architecture_metrics(code_lines(spark, sf))))


_CHUNKS = f"{SHORT_LINES_SQL}, {CODE_CHUNKS_SQL}"
_STEM = "regexp_replace(string_split(file_path, '/')[-1], '\\.[^.]*$', '')"
_TESTS = f"gaps AS (SELECT chunk_id, 'unit_test' AS title, 'medium' AS severity, 'tests/test_' || {_STEM} || '.py' AS stub_path FROM code_chunks WHERE chunk_type IN ('function', 'method') AND NOT contains(file_path, 'test_') AND NOT contains(file_path, 'spec') AND NOT {_match(rules.ACCESSOR, 'symbol_name')} UNION ALL SELECT chunk_id, 'integration_test', 'high', 'tests/test_' || {_STEM} || '_integration.py' FROM code_chunks WHERE {_match(rules.ENDPOINT, 'content')})"


@query(f"WITH {_CHUNKS}, {_TESTS} SELECT * FROM gaps")
def test_gaps(spark, sf):
    return rules.test_gaps(code_chunks(spark, sf))


@query(f"WITH {_CHUNKS}, {_TESTS} SELECT c.chunk_id, count(g.title) AS n_findings, CAST(greatest(0, 100 - 8 * count(g.title)) AS BIGINT) AS score FROM code_chunks c LEFT JOIN gaps g USING (chunk_id) GROUP BY 1")
def test_score(spark, sf):
    chunks = code_chunks(spark, sf)
    return rules.gap_scores(chunks, rules.test_gaps(chunks), "chunk_id", 8)


@query(f"WITH {_CHUNKS} SELECT chunk_id, 'missing_documentation' AS title, 'medium' AS severity FROM code_chunks WHERE chunk_type IN ('function', 'method', 'class') AND NOT CASE WHEN language = 'python' THEN regexp_matches(content, '(?m)^[ \\t]*(''{{3}}|\"{{3}})') ELSE regexp_matches(content, '/\\*\\*|//|#') END UNION ALL SELECT chunk_id, 'missing_api_documentation', 'medium' FROM code_chunks WHERE {_match(rules.ENDPOINT, 'content')} AND NOT (contains(content, 'API') OR contains(lower(content), 'swagger'))")
def doc_gaps(spark, sf):
    return rules.doc_gaps(code_chunks(spark, sf))


# ----------------------------------------------------------- graph and similarity
@query("WITH RECURSIVE e AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS src, CAST((o_orderkey * 17 + o_custkey) % 997 AS BIGINT) AS dst FROM orders), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst")
def import_cycles(spark, sf):
    """Orders as the edges of an import graph."""
    edges = load(spark, sf, "orders").selectExpr("cast(o_custkey as long) as src", "cast((o_orderkey * 17 + o_custkey) % 997 as long) as dst")
    return graph.cycle_members(edges)


@query("WITH sets AS (SELECT doc_id, list_sort(list_distinct(" + WORDS + ")) AS w FROM documents), d AS (SELECT min(doc_id) AS id, w FROM sets WHERE len(w) > 0 GROUP BY w) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM d a JOIN d b ON a.id < b.id AND least(len(a.w), len(b.w)) >= 0.8::DOUBLE * greatest(len(a.w), len(b.w)) WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.8::DOUBLE")
def duplicate_pairs(spark, sf):
    return similarity.jaccard_pairs(load(spark, sf, "documents"), 0.8)


@query("WITH sets AS (SELECT doc_id AS id, sha256(array_to_string(list_sort(list_distinct(" + WORDS + ")), ' ')) AS h FROM documents WHERE len(" + WORDS + ") > 0) SELECT id, min(id) OVER (PARTITION BY h) AS representative FROM sets")
def duplicate_members(spark, sf):
    return similarity.set_members(load(spark, sf, "documents"))


# ------------------------------------------------------------ indexing and tables
@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es') n FULL JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr') o ON n.doc_id = o.doc_id")
def incremental_diff(spark, sf):
    """Two versions of the corpus: Spanish gone, French new, German edited."""
    docs = load(spark, sf, "documents")
    new = docs.where("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("h"))
    old = docs.where("lang <> 'fr'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return indexing.classify_changes(new, old, "doc_id", "h")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def anti_delete(spark, sf):
    gone = load(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return indexing.delete(load(spark, sf, "customer"), gone, "c_nationkey").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey >= 8 UNION ALL SELECT s_suppkey, s_name || '*', s_acctbal + 1 FROM supplier WHERE s_nationkey < 8 UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_acctbal < 0")
def upsert_merge(spark, sf):
    supplier = load(spark, sf, "supplier")
    s = supplier.select("s_suppkey", "s_name", "s_acctbal")
    changed = supplier.where("s_nationkey < 8").selectExpr("s_suppkey", "concat(s_name, '*') as s_name", "s_acctbal + 1 as s_acctbal")
    added = supplier.where("s_acctbal < 0").selectExpr("cast(s_suppkey + 1000000 as long) as s_suppkey", "s_name", "s_acctbal")
    return indexing.upsert(s, changed.union(added), "s_suppkey")


@query("SELECT k.doc_id, c.value, c.value IS NOT NULL AS hit FROM documents k LEFT JOIN (SELECT doc_id, source AS value FROM documents WHERE lang = 'en' AND n_chars + 3600 > 4000) c ON c.doc_id = k.doc_id")
def cache_lookup(spark, sf):
    docs = load(spark, sf, "documents")
    cache = docs.where("lang = 'en'").select(F.col("doc_id").alias("key"), F.col("source").alias("value"), F.col("n_chars").alias("written_at"), F.lit(3600).alias("ttl"))
    return indexing.cached(cache, docs.select(F.col("doc_id").alias("key")), 4000).withColumnRenamed("key", "doc_id")


# -------------------------------------------------------------- metrics and quality
@query("SELECT event_type AS bucket, user_id % 10 AS key, count(value) AS n, round(sum(value), 3) AS total_ms, round(avg(value), 3) AS avg_ms, round(max(value), 3) AS max_ms FROM events GROUP BY ALL")
def latency_stats(spark, sf):
    return evaluation.latency_stats(load(spark, sf, "events").withColumn("k", F.col("user_id") % 10), "event_type", "k", "value")


@query("SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS ratio FROM events")
def error_ratio(spark, sf):
    return evaluation.error_ratio(load(spark, sf, "events"), F.col("event_type") == "error")


@query("SELECT event_type, count(*) FILTER (value < 10) AS hits, count(*) - count(*) FILTER (value < 10) AS misses, count(*) AS requests, round(count(*) FILTER (value < 10) / count(*), 4) AS ratio FROM events GROUP BY event_type")
def cache_ratio(spark, sf):
    return evaluation.cache_ratio(load(spark, sf, "events"), "event_type", F.col("value") < 10)


@query("WITH e AS (SELECT event_type, CASE user_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'gemini' ELSE 'ollama' END AS provider, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events) SELECT provider, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens * CASE provider WHEN 'openai' THEN 0.005::DOUBLE WHEN 'anthropic' THEN 0.008::DOUBLE WHEN 'gemini' THEN 0.001::DOUBLE ELSE 0 END / 1000), 6) AS cost, round(sum(round(tokens::DOUBLE / 1000 * CASE provider WHEN 'openai' THEN 0.00006::DOUBLE WHEN 'anthropic' THEN 0.00008::DOUBLE ELSE 0.00006::DOUBLE END, 6)), 6) AS eval_cost FROM e GROUP BY provider")
def token_cost(spark, sf):
    u = F.col("user_id") % 4
    provider = F.when(u == 0, "openai").when(u == 1, "anthropic").when(u == 2, "gemini").otherwise("ollama")
    rows = load(spark, sf, "events").select(provider.alias("provider"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return rows.groupBy("provider").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(t.llm_cost("provider", "tokens")), 6).alias("cost"), F.round(F.sum(t.evaluation_cost("provider", "tokens")), 6).alias("eval_cost"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r <= 1000) SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS avg, round(max(value) FILTER (r = 1), 6) AS last FROM n GROUP BY event_type")
def cost_last_n(spark, sf):
    return evaluation.last_costs(load(spark, sf, "events"), "event_type", ("ts", "event_id"), "value", 1000)


_QUALITY = f"""{_bm25_sql('', 20)}, truth AS (SELECT b.item_id AS query_id, l.doc_id AS id FROM benchmark b, labels l WHERE l.quality = 1 AND l.doc_id % 40 = b.item_id % 40),
    sizes AS (SELECT query_id, count(DISTINCT id) AS n_relevant FROM truth GROUP BY 1),
    flagged AS (SELECT k.query_id, k.rank, EXISTS (SELECT 1 FROM truth t WHERE t.query_id = k.query_id AND t.id = k.id) AS rel FROM keyword k),
    quality AS (SELECT query_id, round(count(*) FILTER (rel AND rank <= 5) / 5, 6) AS precision, round(coalesce(count(*) FILTER (rel AND rank <= 5) / max(n_relevant), 0), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rel), 0), 6) AS mrr FROM flagged LEFT JOIN sizes USING (query_id) GROUP BY query_id)"""


def _truth(spark, sf):
    good = load(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("m"))
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m")).join(good, "m").select("query_id", "id")


@query(f"WITH {_QUALITY} SELECT * FROM quality")
def retrieval_metrics(spark, sf):
    ranked = retrieval.bm25_topk(load(spark, sf, "documents"), _text_queries(spark, sf), 20)
    return evaluation.retrieval_metrics(ranked, _truth(spark, sf))


@query(f"WITH {_QUALITY} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, CAST(0.0 AS DOUBLE) AS base_precision, CAST(0.0 AS DOUBLE) AS base_recall, CAST(0.0 AS DOUBLE) AS base_mrr, round(avg(precision), 6) AS delta_precision, round(avg(recall), 6) AS delta_recall, round(avg(mrr), 6) AS delta_mrr FROM quality")
def evaluation_report(spark, sf):
    """Against a baseline that finds nothing."""
    metrics = retrieval_metrics(spark, sf)
    baseline = metrics.select("query_id", *[F.lit(0.0).alias(c) for c in ("precision", "recall", "mrr")])
    return evaluation.evaluation_report(metrics, baseline)


@query("WITH s AS (SELECT event_type AS bucket, event_type AS key, count(value) AS n, round(sum(value), 3) AS total_ms, round(max(value), 3) AS max_ms FROM events GROUP BY 1, 2) SELECT 'latency_count{bucket=\"' || bucket || '\",key=\"' || key || '\"} ' || CAST(n AS VARCHAR) AS line FROM s")
def prometheus_counts(spark, sf):
    stats = evaluation.latency_stats(load(spark, sf, "events"), "event_type", "event_type", "value")
    return evaluation.prometheus_lines(stats, "latency").where(F.col("line").startswith("latency_count"))


# --------------------------------------------------------------- reviews and history
_RESULTS = """results AS (SELECT l_orderkey AS review_id, CASE l_linenumber WHEN 1 THEN 'security' WHEN 2 THEN 'performance' WHEN 3 THEN 'testing' WHEN 4 THEN 'documentation' ELSE 'progress' END AS agent, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 101 AS BIGINT) END AS score, CAST(l_suppkey % 3 AS BIGINT) AS n_critical, CAST(l_suppkey % 4 AS BIGINT) AS n_high, CAST(l_partkey % 8 AS BIGINT) AS n_findings, l_linenumber AS step, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem)"""
AGENTS = ("security", "performance", "testing", "documentation")


def _results(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    agent = F.when(n == 1, "security").when(n == 2, "performance").when(n == 3, "testing").when(n == 4, "documentation").otherwise("progress")
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("review_id"), agent.alias("agent"), F.when(p % 9 != 0, (p % 101).cast("long")).alias("score"), (F.col("l_suppkey") % 3).cast("long").alias("n_critical"), (F.col("l_suppkey") % 4).cast("long").alias("n_high"), (p % 8).cast("long").alias("n_findings"), n.alias("step"), F.col("l_quantity").cast("long").alias("tokens"))


@query(f"WITH {_RESULTS}, s AS (SELECT review_id, sum(score) AS s, count(score) AS n, sum(n_critical) AS c, sum(n_high) AS h, sum(n_findings) AS t FROM results WHERE agent <> 'progress' GROUP BY 1) SELECT review_id, CAST(CASE WHEN n > 0 THEN s // n ELSE 50 END AS BIGINT) AS overall, CASE WHEN c >= 3 OR t > 20 THEN '4-6 weeks' WHEN h >= 5 OR t > 10 THEN '2-4 weeks' WHEN t > 0 THEN '1-2 weeks' ELSE '3-7 days' END AS effort FROM s")
def summary_scores(spark, sf):
    return review.summaries(_results(spark, sf))


_PIVOT = "wide AS (SELECT review_id, " + ", ".join(f"max(score) FILTER (agent = '{a}') AS {a}" for a in AGENTS) + " FROM results GROUP BY review_id)"


@query(f"WITH {_RESULTS}, {_PIVOT} SELECT * FROM wide")
def report_pivot(spark, sf):
    return review.reports(_results(spark, sf), AGENTS)


@query(f"WITH {_RESULTS}, {_PIVOT} SELECT review_id, metric, score FROM (" + " UNION ALL ".join(f"SELECT review_id, '{a}' AS metric, {a} AS score FROM wide" for a in AGENTS) + ") WHERE score IS NOT NULL")
def score_unpivot(spark, sf):
    return review.score_rows(review.reports(_results(spark, sf), AGENTS), AGENTS)


@query(f"WITH {_RESULTS}, {_PIVOT}, c AS (SELECT review_id, count(*) AS n FROM results WHERE agent <> 'progress' GROUP BY 1) SELECT o_orderkey AS review_id, o_orderstatus, coalesce(n, 0) AS n_agents, {', '.join(AGENTS)} FROM orders LEFT JOIN c ON c.review_id = o_orderkey LEFT JOIN wide ON wide.review_id = o_orderkey")
def review_detail(spark, sf):
    results = _results(spark, sf)
    reviews = load(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"), "o_orderstatus")
    return review.details(reviews, results, review.reports(results, AGENTS))


@query(f"WITH {_RESULTS}, per AS (SELECT review_id, step, sum(tokens) AS tokens FROM results GROUP BY ALL) SELECT review_id, step, CAST(tokens AS BIGINT) AS tokens, CAST(sum(tokens) OVER (PARTITION BY review_id ORDER BY step) AS BIGINT) AS total_tokens FROM per")
def token_accumulation(spark, sf):
    return review.token_totals(_results(spark, sf).groupBy("review_id", "step").agg(F.sum("tokens").alias("tokens")))


@query("SELECT o_orderkey, o_orderdate, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def history_page(spark, sf):
    """The third page; the limit is the feature."""
    rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_name", "o_totalprice")
    return review.history_page(rows, "o_orderdate", "o_orderkey", 40, 20)


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def history_count(spark, sf):
    return load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("WITH done AS (SELECT o_custkey, o_orderkey % 101 AS overall FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT CAST(c_custkey AS BIGINT) AS repository_id, CAST(coalesce(nullif(overall, 0), 70) AS BIGINT) AS overall FROM customer LEFT JOIN done ON o_custkey = c_custkey")
def latest_per_repo_scores(spark, sf):
    reviews = load(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("review_id"), F.col("o_orderdate").alias("completed_at"), (F.col("o_orderkey") % 101).alias("overall"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    return review.latest_scores(reviews, load(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("repository_id")))


@query("SELECT c_custkey, round(c_acctbal / 100, 0) AS score, CASE WHEN round(c_acctbal / 100, 0) >= 80 THEN 'green' WHEN round(c_acctbal / 100, 0) >= 60 THEN 'yellow' ELSE 'red' END AS colour FROM customer")
def score_colours(spark, sf):
    score = F.round(F.col("c_acctbal") / 100, 0)
    return load(spark, sf, "customer").select("c_custkey", score.alias("score"), t.score_colour(score).alias("colour"))


_TYPES = ("full", "security", "performance", "style", "dependencies", "other")
_REQUESTS = f"SELECT o_orderkey AS review_id, CASE o_orderkey % {len(_TYPES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_TYPES)) + " END AS review_type, CASE WHEN o_custkey % 3 = 0 THEN 'security,testing' END AS focus FROM orders"
_PLAN_CASE = "CASE review_type " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in review.PLANS.items()) + f" ELSE '{','.join(review.PLANS['full'])}' END"


@query(f"SELECT review_id, review_type, focus, array_to_string(list_concat(CASE WHEN focus IS NULL THEN string_split({_PLAN_CASE}, ',') ELSE list_filter(string_split({_PLAN_CASE}, ','), lambda a: a = 'repository' OR list_contains(string_split(focus, ','), a)) END, ['summary']), ',') AS agents FROM ({_REQUESTS})")
def plan_agents(spark, sf):
    """Orders as review requests; every third customer has a focus."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % len(_TYPES) + 1).cast("int"))
    requests = load(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"), kind.alias("review_type"), F.when(F.col("o_custkey") % 3 == 0, "security,testing").alias("focus"))
    plans = review.plan_agents(requests.withColumn("focus", F.split("focus", ",")))
    return plans.select("review_id", "review_type", F.array_join("focus", ",").alias("focus"), F.array_join("agents", ",").alias("agents"))


@query(f"WITH {_CHUNKS}, found AS (SELECT file_path AS src, unnest(list_concat(list_concat(regexp_extract_all(content, 'from\\s+([\\w.\\-/]+)\\s+import', 1), regexp_extract_all(content, 'import\\s+([\\w.\\-/]+)', 1)), regexp_extract_all(content, 'require\\([''\"]([./\\w\\-]+)[''\"]\\)', 1))) AS module FROM code_chunks) SELECT DISTINCT src, string_split(string_split(module, '/')[-1], '.')[1] AS name FROM found")
def import_names(spark, sf):
    chunks = code_chunks(spark, sf)
    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in graph.IMPORTS]))
    return chunks.select(F.col("file_path").alias("src"), F.explode(found).alias("module")).select("src", graph.base_name("module").alias("name")).distinct()


@query()
def repository_chunks(spark, sf):
    """Chunks of source files made of the code lines: parsers have no SQL form."""
    files = code_chunks(spark, sf).select("file_path", "language", "content")
    return repository.chunk_files(files).drop("content")
