"""Derived tables that both engines build alike from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import dealt, load

#: Source lines that set off every rule, dealt by part key.
CODE = (
    "for x in items:", "    cur.execute(q + x)", "async def load(self, request):", "    time.sleep(1)", "password = \"hunter2\"",
    "    result.append(x)", "def compute(a, b):", "    return a + b", "class Basket:", "    def total(self):", "import os", "from pkg.mod import name",
    "rows = db.query(sql)", "eval(text)", "data = jwt.decode(t, verify=False)", "data = jwt.decode(t, key)", "@app.route(\"/home\")", "@login_required",
    "el.innerHTML = value", "@csrf_exempt", "prompt = \"hi \" + user", "query = \"select a from t where b=\" + b", "os.system(\"rm \" + path)",
    "xs = list()", "if user.is_admin:", "while True:", "    switch (kind) {", "# plain comment", "", "x = cache.get(k)", "fetch(\"/api\")",
    "app.get(\"/x\", h)", "requests.get(url)", "    case 3:", "def get_name(self):", "function draw(ctx) {", "}", "const a = require('util')",
    "token: 'abc'", "subprocess.run(f\"ls {d}\")", "return [y for y in ys]",
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def code_lines_sql(key: str) -> str:
    return (
        f"code_lines AS (SELECT CAST({key} AS BIGINT) AS chunk_id, CAST(row_number() OVER (PARTITION BY {key} ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS line_no, "
        f"CASE l_partkey % {len(CODE)} " + " ".join(f"WHEN {i} THEN {_quoted(c)}" for i, c in enumerate(CODE)) + " END AS line FROM lineitem)"
    )


#: Long chunks, one a supplier, and short ones, one an order.
CODE_LINES_SQL, SHORT_LINES_SQL = code_lines_sql("l_suppkey"), code_lines_sql("l_orderkey")
CODE_CHUNKS_SQL = (
    "code_chunks AS (SELECT chunk_id, 'src/' || CASE WHEN chunk_id % 7 = 0 THEN 'test_' ELSE '' END || 'm' || CAST(chunk_id AS VARCHAR) || '.py' AS file_path, "
    "CASE chunk_id % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'class' END AS chunk_type, "
    "CASE WHEN chunk_id % 5 = 0 THEN 'get_' ELSE 'do_' END || CAST(chunk_id AS VARCHAR) AS symbol_name, "
    "CASE WHEN chunk_id % 3 = 0 THEN 'python' ELSE 'javascript' END AS language, string_agg(line, chr(10) ORDER BY line_no) AS content FROM code_lines GROUP BY chunk_id)"
)


def code_lines(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """Dealt by chunk to tasks of a like size: all windows and sums over a chunk follow that deal."""
    items = load(spark, sf_dir, "lineitem").select(F.col(key).cast("long").alias("chunk_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = Window.partitionBy("chunk_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    line = F.element_at(F.array(*map(F.lit, CODE)), (F.col("l_partkey") % len(CODE) + 1).cast("int"))
    return dealt(items, "chunk_id").select("chunk_id", F.row_number().over(order).alias("line_no"), line.alias("line"))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short chunks, each as one text with a path, a kind and a name."""
    c = F.col("chunk_id")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    texts = code_lines(spark, sf_dir, "l_orderkey").groupBy("chunk_id").agg(content.alias("content"))
    return texts.select("chunk_id", F.concat(F.lit("src/"), F.when(c % 7 == 0, "test_").otherwise(""), F.lit("m"), c.cast("string"), F.lit(".py")).alias("file_path"), F.when(c % 4 == 0, "file").when(c % 4 == 1, "function").when(c % 4 == 2, "method").otherwise("class").alias("chunk_type"), F.concat(F.when(c % 5 == 0, "get_").otherwise("do_"), c.cast("string")).alias("symbol_name"), F.when(c % 3 == 0, "python").otherwise("javascript").alias("language"), "content")
