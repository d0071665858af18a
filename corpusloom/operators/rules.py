"""Line rules over source code: security, performance, architecture, tests, documentation.

Input is ``lines(chunk_id, line_no, line)`` with line_no from 1. Rules that see one line
are tested in a single pass; rules that see neighbours use row frames over a chunk's
lines, of flags rather than of joined texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines

# Names, patterns, severities and weights that the rules share with any
# implementation of the same checks.
SECRET_NAMES = ("password", "pass", "secret", "api_key", "token", "access_key", "private_key")
QUOTED = r"""["'`].+?["'`]"""
TRIPLE_QUOTED = r"""['"]{3}.*['"]{3}"""
INTERPOLATED = r"""\+|format\(|f"|f'"""
DB_CALL = r"\b(execute|executemany|query|prepare)\s*\("
DB_MIXED = r"""\+|%\s*[\w(]|format\(|f"|f'"""
SELECT_FROM = r"(?i)\bselect\b.*\bfrom\b"
SELECT_MIXED = r"""\{.*\}|\+|format\(|f"|f'"""
PROCESS_CALL = r"\b(subprocess\.Popen|subprocess\.run|os\.system|popen|shell=\s*True)\b"
PROCESS_MIXED = r"""\+|%\(|format\(|f"|f'"""
DYNAMIC_CODE = r"\b(eval|exec|compile)\s*\("
ROUTE = r"@app\.route|@router\.|def .*\(.*request|def .*\(.*self.*\)"
AUTHENTICATED = ("login_required", "authenticate", "auth_required", "Depends(get_current_user)", "@jwt_required")
ROLE_CHECK = r"if .*\.role|if .*\.is_admin|has_role|is_admin"
AUTHORISED = ("authorize", "permission", "role", "is_admin", "has_role")
SCRIPT_SINK = r"\.innerHTML|dangerouslySetInnerHTML|document\.write|response\.write\(|innerText"
PROMPT = r"prompt\s*=|messages\s*=|system_prompt\s*="
LOOP = r"^\s*(for |while )"
DB_FETCH = r"\b(execute|executemany|query|fetchall|fetchone|session\.query|db\.query|cursor\.execute)\b"
ASYNC = r"async\s+def|async\s+function"
BLOCKING = r"\b(time\.sleep|requests\.|urllib\.|socket\.|open\(|subprocess\.)\b"
LOOP_END = r"^\s*(for |while |def |class )"
ALLOCATION = r"(list\(|\[\]|dict\(|set\(|new\s+Array\(|Array\()"
MUTATION = r"\bappend\(|\.push\(|setdefault\(|dict\[|\]\s*=\s*\{|\badd\("
SCOPE = r"def |class |function"
FUNCTION = r"def\s+\w+\s*\(.*:|function\s+\w+\s*\("
MEMOISED = r"lru_cache|memoize|cache"
CLASS = r"\bclass\b|\binterface\b"
METHOD = r"^\s+def\s+\w+\(|^\s+\w+\s+\w+\s*\(|^\s*\w+\s*:\s*function\(|^\s+async\s+def\s+"
TOP_FUNCTION = r"^def\s+\w+\(|^function\s+\w+\(|^\w+\s+\w+\s*\(.*\)\s*\{"
FUNCTION_END = r"^\s*$|^\s*(def |class |function |interface|\w+\s+\w+\s*\(|#)"
TYPE_CHECK = r"\b(isinstance|type\(|switch|case)\b"
IMPORT = r"^\s*(import |from |require\(|#include |using )"
ENDPOINT = r"@app\.route|@router\.|router\.(get|post|put|delete)|fetch\(|axios\.|express\(|flask\.|FastAPI\(|app\.get\(|app\.post\(|rest_controller"
ACCESSOR = r"^(get|set|is|has)_"
WEIGHTS = {"critical": 30, "high": 20, "medium": 10, "low": 5, "info": 2}
OTHER_WEIGHT = 10


def lines_of(texts: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """(chunk_id, line_no, line) of every line."""
    return texts.select(F.col(id_column).alias("chunk_id"), F.posexplode(split_lines(text_column)).alias("_at", "line")).select("chunk_id", (F.col("_at") + 1).alias("line_no"), "line")


def _any(text: Column, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in names])


def _frame(before: int, after: int):
    return Window.partitionBy("chunk_id").orderBy("line_no").rowsBetween(-before, after)


def _finding(order: int, rule: str, severity: str, confidence: float) -> Column:
    return F.struct(F.lit(order).alias("rule_order"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))


def secret_line(line: Column) -> Column:
    low = F.lower(F.trim(line))
    return _any(low, SECRET_NAMES) & (F.contains(line, F.lit("=")) | F.contains(line, F.lit(":"))) & ~line.rlike(TRIPLE_QUOTED) & line.rlike(QUOTED)


def security_findings(lines: DataFrame) -> DataFrame:
    """(chunk_id, line_no, rule_order, rule, severity, confidence), one scan of the lines."""
    l = F.col("line")  # noqa: E741
    near = _frame(2, 3)
    marked = lines.withColumns({
        "_route": l.rlike(ROUTE), "_role": l.rlike(ROLE_CHECK),
        "_authenticated": F.max(_any(l, AUTHENTICATED)).over(near), "_authorised": F.max(_any(l, AUTHORISED)).over(near),
    })
    none = F.lit(None)
    jwt = F.contains(l, F.lit("jwt.decode"))
    rules = [
        F.when(secret_line(l), _finding(1, "hardcoded_secret", "critical", 0.95)),
        F.when(l.rlike(DB_CALL) & l.rlike(DB_MIXED), _finding(2, "sql_injection", "critical", 0.9)).when(l.rlike(SELECT_FROM) & l.rlike(SELECT_MIXED), _finding(2, "sql_injection_risk", "high", 0.85)),
        F.when(l.rlike(PROCESS_CALL) & l.rlike(PROCESS_MIXED), _finding(3, "command_injection", "critical", 0.9)),
        F.when(l.rlike(DYNAMIC_CODE), _finding(4, "dynamic_code", "high", 0.85)),
        F.when(jwt & F.contains(l, F.lit("verify=False")), _finding(5, "jwt_unverified", "critical", 0.95)).when(jwt & ~F.contains(l, F.lit("algorithms")), _finding(5, "jwt_algorithms", "high", 0.8)),
        F.when(F.col("_route") & ~F.col("_authenticated"), _finding(6, "missing_authentication", "high", 0.8)),
        F.when(F.col("_role") & ~F.col("_authorised"), _finding(7, "missing_authorization", "medium", 0.7)),
        F.when(l.rlike(SCRIPT_SINK), _finding(8, "xss", "high", 0.85)),
        F.when(F.contains(l, F.lit("csrf_exempt")) | (F.contains(l, F.lit("CSRF")) & F.contains(l, F.lit("disabled"))), _finding(9, "csrf", "high", 0.85)),
        F.when(l.rlike(PROMPT) & l.rlike(INTERPOLATED), _finding(10, "prompt_injection", "high", 0.8)),
    ]
    hits = F.filter(F.array(*[r.otherwise(none) for r in rules]), lambda x: x.isNotNull())
    return marked.select("chunk_id", "line_no", F.explode(hits).alias("f")).select("chunk_id", "line_no", "f.*")


def severity_weight(severity: Column) -> Column:
    return reduce(lambda out, kv: F.when(severity == kv[0], F.lit(kv[1])).otherwise(out), WEIGHTS.items(), F.lit(OTHER_WEIGHT))


def security_scores(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """(chunk_id, n_findings, score, summary) of every chunk: 95 without findings."""
    sums = findings.groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum(severity_weight(F.col("severity"))).alias("w"))
    # severities in the order in which they first appear
    seen = findings.groupBy("chunk_id", "severity").agg(F.count("*").alias("n"), F.min(F.struct("rule_order", "line_no")).alias("at"))
    said = seen.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "severity"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["severity"])), ", ").alias("summary"))
    return chunks.select("chunk_id").distinct().join(sums, "chunk_id", "left").join(said, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n_findings"), F.when(F.col("n").isNull(), F.lit(95)).otherwise(F.greatest(F.lit(0), F.lit(100) - F.col("w"))).cast("long").alias("score"), F.coalesce("summary", F.lit("none")).alias("summary"))


def performance_findings(lines: DataFrame) -> DataFrame:
    """(chunk_id, line_no, rule, severity) of loops, blocking calls, allocations and more."""
    l = F.col("line")  # noqa: E741
    chunk = Window.partitionBy("chunk_id")
    rest = Window.partitionBy("chunk_id").orderBy("line_no").rowsBetween(1, 200)
    flags = lines.withColumns({"_loop": l.rlike(LOOP), "_db": l.rlike(DB_FETCH), "_for": l.rlike("for |while"), "_scope": l.rlike(SCOPE), "_stop": F.when(l.rlike(LOOP_END), F.col("line_no"))})
    marked = flags.withColumns({
        "_async": F.max(l.rlike(ASYNC)).over(chunk), "_memo": F.max(l.rlike(MEMOISED)).over(chunk),
        "_db_near": F.max("_db").over(_frame(0, 7)), "_inner": F.coalesce(F.max("_loop").over(_frame(-1, 19)), F.lit(False)),
        "_for_near": F.max("_for").over(_frame(2, 3)), "_scope_near": F.max("_scope").over(_frame(4, 5)),
        "_body": F.coalesce(F.min("_stop").over(rest) - F.col("line_no") - 1, F.count("line_no").over(rest)),
    })

    def hit(test: Column, line_no: Column, rule: str, severity: str) -> Column:
        return F.when(test, F.struct(line_no.cast("long").alias("line_no"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))

    at = F.col("line_no")
    rules = [
        hit(F.col("_loop") & F.col("_db_near"), at, "n_plus_one", "high"),
        hit(F.col("_async") & l.rlike(BLOCKING) & ~F.contains(l, F.lit("await")), at, "blocking_io", "medium"),
        hit(F.col("_loop") & (F.col("_body") > 100), at, "large_loops", "medium"),
        hit(F.col("_loop") & F.col("_inner"), at, "inefficient_algorithms", "high"),
        hit(l.rlike(ALLOCATION) & F.col("_for_near"), at, "redundant_allocations", "low"),
        hit(l.rlike(MUTATION) & ~F.col("_scope_near"), at, "memory_leaks", "medium"),
        hit(l.rlike(FUNCTION) & ~F.col("_memo"), F.lit(1), "recursive_bottlenecks", "high"),
    ]
    return marked.select("chunk_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("f")).select("chunk_id", "f.*")


def performance_scores(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    n = lambda rule: F.coalesce(F.count_if(F.col("rule") == rule), F.lit(0))
    counts = findings.groupBy("chunk_id").agg(F.count("*").alias("n"), n("n_plus_one").alias("a"), n("inefficient_algorithms").alias("b"), n("blocking_io").alias("c"))
    return chunks.select("chunk_id").distinct().join(counts, "chunk_id", "left").fillna(0).select("chunk_id", F.col("n").alias("n_findings"), F.greatest(F.lit(0), F.lit(100) - F.col("a") * 10 - F.col("b") * 8 - F.col("c") * 5).alias("score"))


def architecture_metrics(lines: DataFrame) -> DataFrame:
    """One row a chunk: lines, classes, functions, mean lengths, imports, type checks."""
    l = F.col("line")  # noqa: E741
    order = Window.partitionBy("chunk_id").orderBy("line_no")
    # backwards, so that the frame only grows
    after = Window.partitionBy("chunk_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({"_class": l.rlike(CLASS), "_function": l.rlike(TOP_FUNCTION), "_end": F.when(l.rlike(FUNCTION_END), F.col("line_no"))})
    marked = marked.withColumns({"_in_class": F.max("_class").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_length": F.coalesce(F.min("_end").over(after) - F.col("line_no") - 1, F.count("line_no").over(after))})
    classes, methods = F.count_if("_class"), F.count_if(F.col("_in_class") & l.rlike(METHOD))
    return marked.groupBy("chunk_id").agg(
        F.count("*").alias("num_lines"), classes.alias("num_classes"), F.count_if("_function").alias("num_functions"),
        F.round(F.coalesce(F.avg(F.when(F.col("_function"), F.col("_length"))), F.lit(0.0)), 6).alias("avg_function_length"),
        F.round(F.when(classes > 0, methods / classes).otherwise(F.lit(0.0)), 6).alias("avg_methods_per_class"),
        F.count_if(l.rlike(IMPORT)).alias("num_imports"), F.count_if(l.rlike(TYPE_CHECK)).alias("type_checks"),
    )


def architecture_findings(metrics: DataFrame) -> DataFrame:
    """(chunk_id, title, severity) where a metric passes its threshold."""
    found = lambda test, title, severity: F.when(test, F.struct(F.lit(title).alias("title"), F.lit(severity).alias("severity")))
    rules = [
        found((F.col("num_classes") > 0) & (F.col("avg_methods_per_class") > 12), "large_classes", "high"),
        found(F.col("avg_function_length") > 120, "large_functions", "high"),
        found(F.col("type_checks") > 4, "open_closed", "medium"),
        found(F.col("num_imports") > 15, "high_coupling", "medium"),
    ]
    return metrics.select("chunk_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("f")).select("chunk_id", "f.*")


def architecture_scores(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """Score of each chunk by its findings, imports and size."""
    lost = findings.groupBy("chunk_id").agg(F.sum(F.when(F.col("severity") == "info", 0).otherwise(severity_weight(F.col("severity")))).alias("lost"))
    large = F.when(F.col("num_imports") > 20, 5).otherwise(0) + F.when(F.col("num_lines") > 2000, 10).otherwise(0)
    strength = (F.col("avg_function_length") < 30) & (F.col("num_imports") < 5)
    return metrics.join(lost, "chunk_id", "left").select("chunk_id", F.greatest(F.lit(0), F.lit(100) - F.coalesce("lost", F.lit(0)) - large).cast("long").alias("score"), strength.alias("strength"))


def roadmap(findings: DataFrame) -> DataFrame:
    """(priority, action): what the findings of a repository call for; P3 always."""
    wanted = {"cycles": ("P0", "break cycles"), "duplication": ("P1", "extract shared code"), "large_classes": ("P1", "split classes"), "large_functions": ("P2", "split functions")}
    flags = findings.agg(*[F.coalesce(F.max(F.col("title") == t), F.lit(False)).alias(t) for t in wanted])
    rows = [F.when(F.col(t), F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"))) for t, (p, a) in wanted.items()]
    rows.append(F.struct(F.lit("P3").alias("priority"), F.lit("document modules").alias("action")))
    return flags.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r")).select("r.*")


def test_gaps(chunks: DataFrame) -> DataFrame:
    """(chunk_id, title, severity, stub_path) of symbols and endpoints that want tests.

    chunks(chunk_id, file_path, chunk_type, symbol_name, content)
    """
    path = F.col("file_path")
    in_test = F.contains(path, F.lit("test_")) | F.contains(path, F.lit("spec"))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    unit = F.col("chunk_type").isin("function", "method") & (F.coalesce(F.col("symbol_name"), F.lit("")) != "") & ~in_test & ~F.col("symbol_name").rlike(ACCESSOR)
    found = lambda test, title, severity, tail: F.when(test, F.struct(F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.concat(F.lit("tests/test_"), stem, F.lit(tail)).alias("stub_path")))
    rules = [found(unit, "unit_test", "medium", ".py"), found(F.col("content").rlike(ENDPOINT), "integration_test", "high", "_integration.py")]
    return chunks.select("chunk_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("f")).select("chunk_id", "f.*")


def doc_gaps(chunks: DataFrame) -> DataFrame:
    """(chunk_id, title, severity) of symbols and endpoints without documentation."""
    text = F.col("content")
    documented = F.when(F.col("language") == "python", text.rlike("(?m)^[ \\t]*('{3}|\"{3})")).otherwise(text.rlike(r"/\*\*|//|#"))
    api = text.rlike(ENDPOINT) & ~(F.contains(text, F.lit("API")) | F.contains(F.lower(text), F.lit("swagger")))
    found = lambda test, title: F.when(test, F.struct(F.lit(title).alias("title"), F.lit("medium").alias("severity")))
    rules = [found(F.col("chunk_type").isin("function", "method", "class") & ~documented, "missing_documentation"), found(api, "missing_api_documentation")]
    return chunks.select("chunk_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("f")).select("chunk_id", "f.*")


def gap_scores(units: DataFrame, findings: DataFrame, by: str, penalty: int) -> DataFrame:
    """(by, n_findings, score) of every unit: 100 less ``penalty`` a finding."""
    counts = findings.groupBy(by).agg(F.count("*").alias("n_findings"))
    return units.select(by).distinct().join(counts, by, "left").fillna(0, ["n_findings"]).select(by, "n_findings", F.greatest(F.lit(0), F.lit(100) - F.col("n_findings") * penalty).cast("long").alias("score"))


def _notes(counts: DataFrame, by: str, notes: list[tuple[Column, str, str]]) -> DataFrame:
    rows = F.array(*[F.when(test, F.struct(F.lit(title).alias("title"), F.lit(severity).alias("severity"))) for test, title, severity in notes])
    return counts.select(by, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select(by, "f.*")


def test_notes(chunks: DataFrame, by: str) -> DataFrame:
    """(by, title, severity): what is said of a repository's tests as a whole."""
    path = F.col("file_path")
    a_test = F.contains(path, F.lit("/tests/")) | path.startswith("test_") | path.endswith("_test.py") | F.contains(F.lower(path), F.lit("spec"))
    counts = chunks.groupBy(by).agg(F.count_if(a_test).alias("tests"), F.count_if(F.col("chunk_type").isin("function", "method")).alias("functions"), F.count_if(F.col("content").rlike(ENDPOINT)).alias("endpoints"))
    tests, functions, endpoints = (F.col(c) > 0 for c in ("tests", "functions", "endpoints"))
    return _notes(counts, by, [(~tests, "no_test_suite", "high"), (endpoints, "endpoint_coverage", "high"), (~functions & ~endpoints, "limited_signals", "low"), (tests & ~endpoints, "coverage_targets", "medium")])


def doc_notes(chunks: DataFrame, gaps: DataFrame, by: str) -> DataFrame:
    """(by, title, severity): a missing README, or that nothing is missing at all."""
    readme = chunks.groupBy(by).agg(F.count_if(F.lower("file_path").endswith("readme.md")).alias("readmes"))
    counts = readme.join(gaps.groupBy(by).agg(F.count("*").alias("gaps")), by, "left")
    return _notes(counts, by, [(F.col("readmes") == 0, "missing_readme", "high"), ((F.col("readmes") > 0) & F.col("gaps").isNull(), "no_gaps", "low")])
