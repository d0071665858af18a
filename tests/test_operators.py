"""Operators on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import chat, evaluation, graph, indexing, retrieval, review, rules, similarity


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize("path,language", [("a/b.PY", "python"), ("x.tsx", "typescript"), ("lib/v.hpp", "cpp"), ("README", None), (".gitignore", None), ("a.b/c", None)])
def test_language(spark, path, language):
    assert one(spark, t.language_of("p"), p=path) == language


@pytest.mark.parametrize("path,ignored", [("node_modules/a.js", True), ("a/yarn.lock", True), ("b/c.map", True), ("x.min.js", False), ("src/main.py", False)])
def test_ignored(spark, path, ignored):
    assert one(spark, t.ignored_path("p"), p=path) is ignored


def test_repo_url(spark):
    parse = lambda u: one(spark, t.parse_repo_url("u", r"code\.example\.org"), u=u)
    assert tuple(parse("https://code.example.org/ann/tool.git")) == ("ann", "tool")
    assert tuple(parse("https://code.example.org/ann/tool/")) == ("ann", "tool")
    assert parse("https://other.example.org/ann/tool") is None


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a\nb\n", 2), ("a\r\n\r\nb", 3)])
def test_split_lines(spark, text, n):
    assert len(one(spark, t.split_lines("s"), s=text)) == n


def test_costs_and_effort(spark):
    assert one(spark, t.llm_cost("p", "n"), p="OpenAI", n=2000) == pytest.approx(0.01)
    assert one(spark, t.llm_cost("p", "n"), p="ollama", n=2000) == 0
    assert one(spark, t.evaluation_cost("p", "n"), p="anthropic", n=1000) == pytest.approx(8e-5)
    effort = lambda c, h, n: one(spark, t.effort_bucket(F.col("c"), F.col("h"), F.col("n")), c=c, h=h, n=n)
    assert [effort(3, 0, 3), effort(0, 5, 5), effort(0, 0, 1), effort(0, 0, 0)] == ["4-6 weeks", "2-4 weeks", "1-2 weeks", "3-7 days"]


def test_fence_and_grounding(spark):
    assert one(spark, t.strip_fence("s"), s='```json\n{"a": 1}\n```') == '{"a": 1}'
    guard = t.grounded(F.col("a"), F.array(F.col("f")), "no")
    assert one(spark, guard, a="see x.py", f="x.py") == "see x.py"
    assert one(spark, guard, a="see y.py", f="x.py") == "no"


def _bm25(docs, query):
    words = [d.lower().split() for d in docs]
    mean = sum(map(len, words)) / len(words)
    out = []
    for w in words:
        s = 0.0
        for q in query.lower().split():
            df = sum(q in x for x in words)
            tf = w.count(q)
            s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        out.append(round(s, 6))
    return out


def test_bm25_counts_repeated_words_and_fills_up(spark):
    texts = ["def login user", "render page template", "login login password check", "misc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ask = spark.createDataFrame([(1, "login login password")], "query_id long, text string")
    rows = retrieval.bm25_topk(docs, ask, 4).orderBy("rank").collect()
    want = _bm25(texts, "login login password")
    assert [r.id for r in rows] == [2, 0, 1, 3]
    assert [r.score for r in rows] == pytest.approx([want[i] for i in (2, 0, 1, 3)], abs=1e-5)


def test_vector_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x[7] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    ask = vectors.where("vec_id in (3, 9)").withColumnRenamed("vec_id", "query_id")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in (3, 9):
        want = sorted(range(200), key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:5]
        got = [r.id for r in retrieval.vector_topk(vectors, ask, 5).where(F.col("query_id") == q).orderBy("rank").collect()]
        assert got == want


def test_merge_overlap_and_rerank(spark):
    side = "query_id long, id long, score double, rank int"
    semantic = spark.createDataFrame([(1, 1, 0.95, 1), (1, 2, 0.6, 2)], side)
    keyword = spark.createDataFrame([(1, 1, 3.2, 1), (1, 3, 1.1, 2)], side)
    merged = retrieval.merge_candidates(semantic, keyword)
    assert merged.count() == 3
    assert tuple(retrieval.overlap(merged).first()) == (1, 1, 0.5)
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "beta delta")], "query_id long, text string")
    rows = retrieval.best(retrieval.rerank(merged, docs, ask), 3).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 2, 3]
    assert rows[0].score == pytest.approx(0.7 + 0.3 + 0.025)


def test_multi_query_and_budget(spark):
    rows = [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 2, 1, "x"), ("a", 2, 2, "z"), ("a", 2, 6, "w")]
    got = retrieval.multi_query(spark.createDataFrame(rows, "agent string, query_no int, rank int, key string"), 5, 15).orderBy("position").collect()
    assert [r.key for r in got] == ["x", "y", "z"]
    blocks = spark.createDataFrame([(1, 1, "a" * 30), (1, 2, "b" * 80), (1, 3, "c")], "g int, n int, text string")
    assert [r.n for r in retrieval.context_budget(blocks, "g", ("n",), budget=100).collect()] == [1]


def _security(spark, text):
    return {(r.rule, r.line_no) for r in rules.security_findings(rules.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id")).collect()}


@pytest.mark.parametrize(
    "line,rule",
    [('password = "abc"', "hardcoded_secret"), ('db.execute("a" + x)', "sql_injection"), ('q = "select a from t where b=" + c', "sql_injection_risk"), ('os.system("rm " + p)', "command_injection"), ("eval(x)", "dynamic_code"), ("jwt.decode(t, verify=False)", "jwt_unverified"), ("jwt.decode(t)", "jwt_algorithms"), ("el.innerHTML = x", "xss"), ("@csrf_exempt", "csrf"), ('prompt = f"hi {x}"', "prompt_injection")],
)
def test_security_rules(spark, line, rule):
    assert (rule, 2) in _security(spark, f"first\n{line}\nlast")


def test_guarded_route_and_quiet_code(spark):
    assert not {r for r, _ in _security(spark, "@login_required\n@app.route('/x')\ndef f():\n    pass")} & {"missing_authentication"}
    assert ("missing_authentication", 1) in _security(spark, "@app.route('/x')\ndef f():\n    pass")
    assert not _security(spark, "x = 1\ny = x")


def test_security_score(spark):
    chunks = spark.createDataFrame([(1,), (2,)], "chunk_id int")
    lines = rules.lines_of(spark.createDataFrame([(1, 'token = "a"\neval(x)'), (2, "ok")], "id int, text string"), "id")
    got = {r.chunk_id: (r.score, r.summary) for r in rules.security_scores(chunks, rules.security_findings(lines)).collect()}
    assert got == {1: (50, "1 critical, 1 high"), 2: (95, "none")}


def _performance(spark, text):
    return {(r.rule, r.line_no) for r in rules.performance_findings(rules.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id")).collect()}


def test_performance_rules(spark):
    assert ("n_plus_one", 1) in _performance(spark, "for x in y:\n    cursor.execute(q)")
    assert ("blocking_io", 2) in _performance(spark, "async def f():\n    time.sleep(1)")
    assert ("inefficient_algorithms", 1) in _performance(spark, "for x in y:\n    for z in x:\n        pass")
    assert ("redundant_allocations", 2) in _performance(spark, "for x in y:\n    a = list()")
    assert ("memory_leaks", 1) in _performance(spark, "items.append(1)")
    assert ("recursive_bottlenecks", 1) in _performance(spark, "def fib(n):\n    return fib(n - 1)")
    assert ("recursive_bottlenecks", 1) not in _performance(spark, "@lru_cache\ndef fib(n):\n    return fib(n - 1)")
    assert ("large_loops", 1) in _performance(spark, "for x in y:\n" + "    a\n" * 101)
    assert ("large_loops", 1) not in _performance(spark, "for x in y:\n" + "    a\n" * 100)


def test_architecture(spark):
    text = "class A:\n" + "".join(f"    def m{i}(self):\n        pass\n" for i in range(14))
    metrics = rules.architecture_metrics(rules.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id"))
    row = metrics.first()
    assert (row.num_classes, row.avg_methods_per_class) == (1, 14.0)
    assert [r.title for r in rules.architecture_findings(metrics).collect()] == ["large_classes"]
    assert rules.architecture_scores(metrics, rules.architecture_findings(metrics)).first().score == 80
    assert {r.priority for r in rules.roadmap(rules.architecture_findings(metrics)).collect()} == {"P1", "P3"}


def test_cycles(spark):
    files = [("src/a.py", "from b import x"), ("src/b.py", "import c"), ("src/c.py", "import a"), ("src/d.py", "import a")]
    edges = graph.import_edges(spark.createDataFrame(files, "file_path string, content string"))
    assert {r.node for r in graph.cycle_members(edges).collect()} == {"src/a.py", "src/b.py", "src/c.py"}
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 2), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7), (8, 1)], "src long, dst long")
    assert {r.node for r in graph.cycle_members(edges).collect()} == {1, 2, 3, 5, 6, 7}
    assert graph.cycle_members(edges.where("src > 99")).count() == 0


def test_duplicates(spark):
    chunks = spark.createDataFrame([(1, "def add(a, b): return a + b"), (2, "def add(a, c): return a + c"), (3, "x")], "chunk_id int, content string")
    assert [(r.a, r.b) for r in similarity.duplicated_code(chunks).collect()] == [(1, 2)]
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "j i h g f e d c b a"), (4, "z"), (5, "")], "doc_id long, text string")
    assert [tuple(r) for r in similarity.jaccard_pairs(docs, 0.8).collect()] == [(1, 2, 0.818182)]
    assert {(r.id, r.representative) for r in similarity.set_members(docs).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4)}


def test_incremental(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, h string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "k string, h string")
    assert dict(map(tuple, indexing.classify_changes(new, old, "k", "h").collect())) == {"a": "unchanged", "b": "changed", "c": "added", "d": "removed"}
    once = indexing.upsert(old, indexing.to_index(new, old, "k", "h"), "k")
    assert indexing.to_index(new, once, "k", "h").count() == 0


def test_embedding_batches_keep_order_and_use_the_cache(spark):
    texts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "idx int, text string")
    cache = spark.createDataFrame([("b", [9.0] * 64)], "text string, embedding array<double>").select(t.content_hash("text").alias("content_hash"), "embedding")
    rows = indexing.embed(texts, cache).orderBy("idx").collect()
    assert [r.source for r in rows] == ["provider", "cache", "provider"]
    assert rows[0].embedding == rows[2].embedding == indexing.hashed_embedding(["a"])[0].tolist()

    def broken(_):
        raise OSError("down")

    assert {r.source for r in indexing.embed(texts, cache, broken, attempts=1).collect()} == {"cache", "failed"}


def test_quality_metrics(spark):
    ranked = spark.createDataFrame([(1, i, f) for i, f in enumerate("xaybz", 1)], "query_id int, rank int, id string")
    truth = spark.createDataFrame([(1, f) for f in "abcd"], "query_id int, id string")
    assert tuple(evaluation.retrieval_metrics(ranked, truth, 5).first()) == (1, 0.4, 0.5, 0.5)


def test_planner(spark):
    rows = spark.createDataFrame([("security", None), ("nonsense", None), ("full", ["testing"])], "review_type string, focus array<string>")
    got = [r.agents for r in review.plan_agents(rows).collect()]
    assert got[0] == ["repository", "security", "dependencies", "summary"]
    assert len(got[1]) == 8 and got[2] == ["repository", "testing", "summary"]
    plans = spark.createDataFrame([(1, [("testing", 1), ("nobody", 9), ("security", 7), ("summary", None)])], "plan_id int, agents array<struct<name:string,priority:int>>")
    assert review.checked_plan(plans).first().agents == ["security", "summary", "testing"]
    state = spark.createDataFrame([(1, ["testing", "summary"], "security"), (2, ["summary"], "summary")], "plan_id int, agents array<string>, current string")
    assert [r.next for r in review.next_stage(state).orderBy("plan_id").collect()] == ["testing", "end"]


def test_replies(spark):
    rows = spark.createDataFrame([('```json\n{"score": 80, "findings": [{"severity": "high"}], "summary": "s"}\n```',), ("plain words",)], "reply string")
    parsed = [r.parsed for r in review.parse_replies(rows).collect()]
    assert parsed[0].score == 80 and parsed[0].findings[0].severity == "high"
    assert (parsed[1].score, parsed[1].summary, parsed[1].findings) == (50, "plain words", [])
    defaults = review.parse_replies(rows).select(review.normal_findings(F.col("parsed.findings"), F.lit("style")).alias("f")).first().f
    assert tuple(defaults[0]) == ("high", "style", "Finding")


def test_review_runs_planned_agents_in_order(spark):
    seen = []
    make = lambda name, score: lambda: spark.createDataFrame([(name, score)], "agent string, score int")
    out = review.run_review(spark, "security", {n: make(n, s) for n, s in (("security", 60), ("dependencies", 80), ("testing", 1))}, progress=seen.append)
    assert seen == ["security", "dependencies"] and out.count() == 2


def test_answers_are_grounded(spark):
    chunks = spark.createDataFrame([(1, "src/a.py", "f", 1, 2, "def f(): pass"), (2, "src/b.py", None, 3, 9, "x" * 5000), (3, "src/c.py", "g", 1, 1, "late")], "id long, file_path string, symbol_name string, start_line int, end_line int, content string")
    ranked = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 2, 1)], "query_id long, id long, rank int")
    found = chat.contexts(ranked, chunks, 300)
    row = found.where("query_id = 1").first()
    assert row.context.startswith("File: src/a.py | Symbol: f | Lines: 1-2\n```\ndef f(): pass\n```\nFile: src/c.py") and row.sources == ["src/a.py", "src/c.py"]
    assert found.where("query_id = 2").count() == 0  # the first block alone is over the budget
    asked = spark.createDataFrame([(1, "where"), (2, "what")], "query_id long, text string")
    told = {r.query_id: r.answer for r in chat.answers(asked, found, lambda qs, cs: ["see src/a.py" if c else "nothing known" for c in cs]).collect()}
    assert told == {1: "see src/a.py", 2: "nothing known"}
    assert chat.answers(asked.where("query_id = 1"), found, lambda qs, cs: ["trust me"] * len(qs)).first().answer == chat.REFUSAL
    assert chat.ready(spark.createDataFrame([("a", "ready"), ("b", "error")], "id string, status string")).count() == 1
