"""Scalar functions over paths, texts and numbers, as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes by language, ignored folders and files, manifest names.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}
IGNORED_DIRS = ("node_modules", "venv", ".venv", "env", "dist", "build", ".git", "__pycache__", ".pytest_cache", ".mypy_cache", "target", "vendor", ".next", "coverage", ".idea", ".vscode")
IGNORED_FILES = (".DS_Store", "package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock")
IGNORED_SUFFIXES = (".map", ".lock")
DEPENDENCY_FILES = ("requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "package.json", "Cargo.toml", "pom.xml", "build.gradle", "go.mod", "Gemfile", "composer.json")
#: Unicode words; the same in Spark and in engines whose \w is ASCII.
WORD = r"[\p{L}\p{N}_]+"
# Prices per 1,000 tokens by provider, for operation and for evaluation.
LLM_RATES = {"openai": 0.005, "anthropic": 0.008, "gemini": 0.001, "deepseek": 0.0005}
EVALUATION_RATES = {"openai": 0.00006, "anthropic": 0.00008, "gemini": 0.00006, "bge": 0.00008}
EVALUATION_RATE = 0.00006


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def suffix(path: Column | str) -> Column:
    """The last suffix of a file name; a name that only starts with a dot has none."""
    return F.regexp_extract(as_column(path), r"[^/.][^/]*(\.[^./]+)$", 1)


def language_of(path: Column | str) -> Column:
    """Language by the last suffix in lower case, or null."""
    ext = F.lower(suffix(path))
    return reduce(lambda out, kv: F.when(ext == kv[0], F.lit(kv[1])).otherwise(out), LANGUAGES.items(), F.lit(None).cast("string"))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def ignored_path(path: Column | str) -> Column:
    parts = F.split(as_column(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS))) | file_name(path).isin(*IGNORED_FILES) | suffix(path).isin(*IGNORED_SUFFIXES)


def is_dependency_file(name: Column | str) -> Column:
    return as_column(name).isin(*DEPENDENCY_FILES)


def tokens(text: Column | str) -> Column:
    """Lower-case words in text order."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD), F.lit(0))


def strip(text: Column | str) -> Column:
    """The text without outer white space of any kind."""
    return F.regexp_replace(as_column(text), r"^\s+|\s+$", "")


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the text without outer white space."""
    return F.sha2(strip(text), 256)


def line_count(text: Column | str) -> Column:
    t = as_column(text)
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1


def split_lines(text: Column | str) -> Column:
    """Lines without a last empty one; an empty text has none."""
    t = F.regexp_replace(as_column(text), r"\R\z", "")
    return F.when(F.length(as_column(text)) == 0, F.array().cast("array<string>")).otherwise(F.split(t, r"\R"))


def has_content(text: Column | str) -> Column:
    return as_column(text).rlike(r"\S")


def indexable_chunk(text: Column | str) -> Column:
    """Neither empty nor a short comment."""
    t = strip(text)
    return (F.length(t) > 0) & ~((F.length(t) < 10) & t.startswith("#"))


def parse_repo_url(url: Column | str, host: str) -> Column:
    """(owner, name) of a repository address, null where it is none."""
    pattern = rf"^(?:https?://)?(?:www\.)?{host}/([^/\s]+)/([^/\s]+?)(?:\.git)?/?$"
    u = as_column(url)
    return F.when(u.rlike(pattern), F.struct(F.regexp_extract(u, pattern, 1).alias("owner"), F.regexp_extract(u, pattern, 2).alias("name")))


def first_nonzero(*values: Column) -> Column:
    """The first value that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values], F.lit(0))


def llm_cost(provider: Column | str, n_tokens: Column | str) -> Column:
    p, n = F.lower(as_column(provider)), as_column(n_tokens)
    rate = reduce(lambda out, kv: F.when(p == kv[0], F.lit(kv[1])).otherwise(out), LLM_RATES.items(), F.lit(0.0))
    return F.when(n <= 0, F.lit(0.0)).otherwise(n.cast("double") / F.lit(1000.0) * rate)


def evaluation_cost(provider: Column | str, n_tokens: Column | str) -> Column:
    p, n = F.lower(as_column(provider)), as_column(n_tokens)
    rate = reduce(lambda out, kv: F.when(p == kv[0], F.lit(kv[1])).otherwise(out), EVALUATION_RATES.items(), F.lit(EVALUATION_RATE))
    return F.round(n.cast("double") / F.lit(1000.0) * rate, 6)


def effort_bucket(critical: Column, high: Column, total: Column) -> Column:
    return F.when((critical >= 3) | (total > 20), "4-6 weeks").when((high >= 5) | (total > 10), "2-4 weeks").when(total > 0, "1-2 weeks").otherwise("3-7 days")


def score_colour(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "yellow").otherwise("red")


def context_block(file_path: Column, symbol: Column, first: Column, last: Column, text: Column, most: int = 2000) -> Column:
    """A cited snippet: header line and fenced text of at most ``most`` characters."""
    head = F.concat(F.lit("File: "), file_path, F.when(symbol.isNotNull() & (symbol != ""), F.concat(F.lit(" | Symbol: "), symbol)).otherwise(""), F.lit(" | Lines: "), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.concat(head, F.lit("\n```\n"), F.substring(text, 1, most), F.lit("\n```"))


def grounded(answer: Column, sources: Column, refusal: str) -> Column:
    """The answer, or the refusal where the answer names none of its sources' files."""
    cited = F.exists(sources, lambda s: F.contains(answer, s))
    return F.when((answer != refusal) & (F.size(sources) > 0) & ~cited, F.lit(refusal)).otherwise(answer)


def strip_fence(text: Column | str) -> Column:
    """What a fenced code block holds, or the text itself."""
    t = strip(text)
    inner = F.regexp_extract(t, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(t)


def overview(languages: Column, frameworks: Column) -> Column:
    """A sentence on language counts (map) and frameworks (array), in sorted order."""
    named = F.array_join(F.transform(F.array_sort(F.map_entries(languages)), lambda e: F.concat(e["key"], F.lit(" ("), e["value"].cast("string"), F.lit(")"))), ", ")
    used = F.when(F.size(frameworks) > 0, F.concat(F.lit(" using "), F.array_join(F.array_sort(frameworks), ", "))).otherwise("")
    return F.when(F.size(languages) > 0, F.concat(F.lit("Repository with "), named, used, F.lit("."))).otherwise("No supported source files.")


def duration_text(ms: Column | str) -> Column:
    """Milliseconds below a second, else seconds with one place, halves going up; a dash for none."""
    m = as_column(ms)
    tenths = F.floor((m + 50) / 100)
    return F.when(F.coalesce(m, F.lit(0)) == 0, "—").when(m < 1000, F.concat(m.cast("string"), F.lit("ms"))).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")))


# Colours of the severities.
SEVERITY_COLOURS = {"critical": "red", "high": "orange", "medium": "yellow", "low": "blue", "info": "muted"}


def severity_colour(severity: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_COLOURS.items() for x in kv])[as_column(severity)], F.lit(SEVERITY_COLOURS["info"]))


def token_usage(reply: Column | str, text: Column | str) -> Column:
    """Tokens that a model's JSON reply reports, in total or in and out, in any of the places
    where providers put them; else a quarter of the text's length."""
    def reported(parsed: Column) -> Column:
        at = lambda path: F.try_variant_get(parsed, f"$.{path}", "string").try_cast("long")
        places = []
        for place, names in (("token_usage", ("input", "output")), ("usage", ("input", "output")), ("usage_metadata", ("input", "output")), ("response_metadata.token_usage", ("prompt", "completion")), ("response_metadata.usage", ("prompt", "completion"))):
            places += [at(place), at(f"{place}.total_tokens"), sum((F.coalesce(at(f"{place}.{n}_tokens"), F.lit(0)) for n in names), F.lit(0))]
        return first_nonzero(*places, F.lit(0))

    # a lambda's argument is evaluated once, so the reply is parsed once a row
    found = F.transform(F.array(F.try_parse_json(as_column(reply))), reported)[0]
    return first_nonzero(found, F.floor(F.length(as_column(text)) / 4))


def latency_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.floor((F.unix_micros(as_column(end).cast("timestamp")) - F.unix_micros(as_column(start).cast("timestamp"))) / 1000)


# Folders that an index run leaves out, and its languages by suffix.
INDEX_IGNORED = (".git", "node_modules", "dist", "build", "venv", "__pycache__")
INDEX_LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".cpp": "C++", ".cc": "C++",
    ".cxx": "C++", ".h": "C++", ".hpp": "C++", ".c": "C++", ".md": "Markdown", ".markdown": "Markdown",
}


def index_language(path: Column | str) -> Column:
    """The language under which an index run counts a path; null if it leaves it out."""
    parts = F.split(as_column(path), "/")
    out = F.exists(parts, lambda p: p.startswith(".") | p.isin(*INDEX_IGNORED))
    return F.when(~out, F.create_map(*[F.lit(x) for kv in INDEX_LANGUAGES.items() for x in kv])[F.lower(suffix(path))])
