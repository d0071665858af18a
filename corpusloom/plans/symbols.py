"""Named queries that relate rows of code to the symbols around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation, intervals, rules
from ..sources import repository
from ..sources.storage import cut, load
from .catalog import _SECURITY, query
from .fixtures import code_lines

_SYMBOLS = """heads AS (SELECT chunk_id, line_no, CASE WHEN starts_with(ltrim(line), 'class ') THEN 'class' WHEN starts_with(ltrim(line), 'def ') THEN 'function' END AS kind, max(line_no) OVER (PARTITION BY chunk_id) AS last FROM code_lines),
    symbols AS (SELECT chunk_id, kind, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY chunk_id ORDER BY line_no) - 1, last) AS end_line FROM heads WHERE kind = 'class'
        UNION ALL SELECT chunk_id, kind, start_line, end_line FROM (SELECT *, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY chunk_id ORDER BY line_no) - 1, last) AS end_line FROM heads WHERE kind IS NOT NULL) WHERE kind = 'function')"""


def symbol_ranges(lines: DataFrame) -> DataFrame:
    """(chunk_id, kind, start_line, end_line): a class reaches to the next class, a function to the next head."""
    plain = F.ltrim("line")
    kind = F.when(plain.startswith("class "), "class").when(plain.startswith("def "), "function")
    last = F.max("line_no").over(Window.partitionBy("chunk_id"))
    # the lines are read once: both kinds are made of the heads alone
    heads = cut(lines.select("chunk_id", "line_no", kind.alias("kind"), last.alias("last")).where("kind is not null"))
    to_next = F.coalesce(F.lead("line_no").over(Window.partitionBy("chunk_id").orderBy("line_no")) - 1, "last")
    ranges = lambda df: df.select("chunk_id", "kind", F.col("line_no").alias("start_line"), to_next.alias("end_line"))
    return ranges(heads.where("kind = 'class'")).union(ranges(heads).where("kind = 'function'"))


@query(f"WITH {_SECURITY}, {_SYMBOLS} SELECT f.chunk_id, f.line_no, f.rule, s.kind, s.start_line, s.end_line FROM findings f LEFT JOIN symbols s ON s.chunk_id = f.chunk_id AND f.line_no BETWEEN s.start_line AND s.end_line QUALIFY row_number() OVER (PARTITION BY f.chunk_id, f.line_no, f.rule_order ORDER BY s.start_line DESC, s.end_line) = 1")
def finding_symbols(spark, sf):
    """Every security finding with the innermost class or function around it."""
    lines = code_lines(spark, sf)
    found = cut(rules.security_findings(lines).select("chunk_id", "line_no", "rule"))
    return intervals.innermost(found, cut(symbol_ranges(lines)), ["chunk_id"], "line_no", "start_line", "end_line", ["kind"]).select("chunk_id", "line_no", "rule", "kind", "start_line", "end_line")


@query("""WITH s AS (SELECT event_type AS key, count(value) AS n, round(sum(value), 3) AS total_ms, round(max(value), 3) AS max_ms FROM events GROUP BY 1),
    l AS (SELECT unnest(['count', 'sum', 'max']) AS part, * FROM s)
    SELECT 'latency_' || part || '{bucket="' || key || '",key="' || key || '"}' AS series, CASE part WHEN 'count' THEN CAST(n AS DOUBLE) WHEN 'sum' THEN total_ms ELSE max_ms END AS value FROM l""")
def prometheus_series(spark, sf):
    """All three lines of a key, read back as series and value."""
    lines = evaluation.prometheus_lines(evaluation.latency_stats(load(spark, sf, "events"), "event_type", "event_type", "value"), "latency")
    return lines.select(F.regexp_extract("line", r"^(.*) \S+$", 1).alias("series"), F.regexp_extract("line", r" (\S+)$", 1).cast("double").alias("value"))


_PACKAGES = ("fastapi", "Django", "flask_cors", "react-dom", "next", "vue-router", "@angular/core", "express", "spring_boot_starter", "rails", "gin-gonic/gin", "actix_web", "numpy", "requests")


@query(
    f"WITH names AS (SELECT CASE p_partkey % {len(_PACKAGES)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PACKAGES)) + " END || ' ' || p_name AS name FROM part) "
    f"SELECT DISTINCT name, framework FROM names JOIN (VALUES {', '.join(repr(kv) for kv in repository.FRAMEWORKS.items())}) AS f(k, framework) ON contains(replace(lower(name), '_', '-'), k)"
)
def framework_names(spark, sf):
    """Parts under package names, against the twelve framework keys."""
    package = F.element_at(F.array(*map(F.lit, _PACKAGES)), (F.col("p_partkey") % len(_PACKAGES) + 1).cast("int"))
    return repository.frameworks(load(spark, sf, "part").select(F.concat(package, F.lit(" "), "p_name").alias("dependency"))).select("name", "framework")
