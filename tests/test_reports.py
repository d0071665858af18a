"""Index runs, results, starter texts, reports and the stateful stream."""

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import evaluation, indexing, retrieval, review
from corpusloom.sources import repository
from corpusloom.streaming import metrics


def test_index_run_touches_changed_files_only(spark):
    files = spark.createDataFrame([("a", "one\ntwo"), ("b", "three"), ("c", "")], "file_path string, content string")
    hashes = files.where("file_path = 'b'").select("file_path", F.sha2("content", 256).alias("content_hash")).union(spark.createDataFrame([("a", "old"), ("gone", "x")], "file_path string, content_hash string"))
    vectors = spark.createDataFrame([("a", "stale"), ("b", "three"), ("gone", "g")], "file_path string, unit string")
    asked = []

    def chunk(rows):
        asked.extend(r.file_path for r in rows.collect())
        return rows.select("file_path", F.explode(F.split("content", "\n")).alias("unit")).where("unit <> ''")

    new, stored, counters = indexing.index_repository(files, hashes, vectors, chunk, lambda units: units)
    assert sorted(asked) == ["a", "c"]
    assert sorted(map(tuple, stored.collect())) == [("a", "one"), ("a", "two"), ("b", "three"), ("gone", "g")]
    assert tuple(counters.first()) == (1, 2, 2)
    # a second run finds nothing to do, the empty file included
    again = indexing.index_repository(files, new, stored, chunk, lambda units: units)
    assert tuple(again[2].first()) == (0, 3, 0) and len(asked) == 2
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, stored.collect()))


def test_index_counters_of_nothing(spark):
    plan = indexing.index_plan(spark.createDataFrame([], "file_path string, content_hash string, n_units int"), spark.createDataFrame([], "file_path string, content_hash string"))
    assert tuple(indexing.index_counters(plan).first()) == (0, 0, 0)


def test_results_have_all_fields(spark):
    ranked = spark.createDataFrame([(1, 1, "x", "", "h"), (1, 2, "y", "s", None), (1, 3, "z", "", None)], "query_id int, rank int, content string, sha256 string, content_hash string")
    rows = retrieval.result_rows(ranked, 2).orderBy("rank").collect()
    assert [r.sha256 for r in rows] == ["h", "s"] and set(retrieval.RESULT_FIELDS) <= set(rows[0].asDict())


def test_metadata_must_be_equal_and_a_missing_language_passes(spark):
    rows = spark.createDataFrame([(1, None, {"k": "v"}), (2, "", {"k": "w"}), (3, "en", {}), (4, "de", {"k": "v"}), (5, "en", None), (6, "en", {"k": "v"})], "id int, language string, metadata map<string,string>")
    assert [r.id for r in rows.where(retrieval.matches("en", {"k": "v"})).orderBy("id").collect()] == [1, 6]
    assert rows.where(retrieval.matches()).count() == 6


def test_scorer_that_fails_gives_zeros(spark):
    answers = spark.createDataFrame([(1, "a"), (2, "b")], "id int, answer string")

    def fails(pdf):
        raise RuntimeError("no model")

    def scores(pdf):
        return pd.DataFrame({c: pdf["id"] / 2.0 for c in evaluation.RAG_METRICS})

    for scorer, want in ((None, [0.0, 0.0]), (fails, [0.0, 0.0]), (scores, [0.5, 1.0])):
        assert [r.faithfulness for r in evaluation.rag_scores(answers, scorer).orderBy("id").collect()] == want


def test_report_as_markdown(spark):
    row = dict(precision=0.5, recall=0.25, mrr=1.0, retrieval_ms=10, llm_ms=31, tokens=2000, faithfulness=0.0, context_precision=0.0, context_recall=0.0, answer_relevancy=0.75)
    rows = [{"repo": "r", "baseline": False, **row}, {"repo": "r", "baseline": False, **row, "llm_ms": 32}, {"repo": "r", "baseline": True, **row, "llm_ms": 41, "answer_relevancy": 0.5}, {"repo": "s", "baseline": False, **row}]
    report = evaluation.evaluation_runs(spark.createDataFrame(rows), "repo", "openai")
    text = {r.repo: r.markdown for r in evaluation.report_markdown(report, "repo").collect()}
    assert text["r"].startswith("# Evaluation report\n\n- repo: r\n- samples: 2\n\n## Retrieval\n- Precision@k: 0.500\n- Recall@k: 0.250\n- MRR: 1.000\n")
    assert "## Latency\n- Retrieval: 10 ms\n- Model: 31 ms\n- Total: 41 ms\n\n## Cost\n- Tokens: 4000\n" in text["r"]
    assert text["r"].endswith("## Comparison\n- Relevancy: 0.2500\n- USD: 0.000120\n- Latency: -10 ms")
    assert "## Baseline" not in text["s"] and "## Comparison" not in text["s"]


def test_tree_leaves_out_hidden_and_built(spark):
    files = spark.createDataFrame([("a/b/c/d/e.py",), ("x.py",), (".git/config",), (".env.example",), ("a/dist/z.js",)], "path string")
    rows = {(r.parent, r.name, r.kind) for r in repository.folder_tree(files).collect()}
    assert rows == {("", "a", "directory"), ("a", "b", "directory"), ("a/b", "c", "directory"), ("a/b/c", "d", "truncated"), ("", "x.py", "file"), ("", ".env.example", "file")}


def test_tokens_fall_back_to_the_text(spark):
    rows = spark.createDataFrame([('{"usage": {"total_tokens": 0, "input_tokens": 3, "output_tokens": 4}}', "x"), ("no json", "12345678"), (None, None), ('{"token_usage": 9}', "")], "reply string, said string")
    assert [r[0] for r in rows.select(t.token_usage("reply", "said")).collect()] == [7, 2, 0, 9]


def test_readme_names_commands_once():
    text = review.readme("P", ["javascript", "typescript"], [], {"javascript": "npm install", "typescript": "npm install"})
    assert text.count("npm install") == 1 and "Frameworks" not in text


def test_stateful_stream_keeps_the_newest(spark, tmp_path):
    folder, late = tmp_path / "in", tmp_path / "late.parquet"
    folder.mkdir()
    at = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame([(i, at + pd.Timedelta(minutes=(i * 37) % 101), i % 3, "ab"[i % 2], float(i), "") for i in range(100)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    query = metrics.last_costs(metrics.event_stream(spark, str(folder)), keep=20).writeStream.format("memory").queryName("stateful_costs").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for i, part in enumerate((rows[:60], rows[60:])):
            part.to_parquet(late)
            late.rename(folder / f"events{i}.parquet")
            query.processAllAvailable()
        got = spark.table("stateful_costs").collect()
    finally:
        query.stop()
    assert len(got) == 4
    for r in got[2:]:
        kept = rows[rows.event_type == r.event_type].sort_values(["ts", "event_id"]).tail(20)["value"]
        assert (r.n, r.total, r["last"]) == (20, kept.sum(), kept.iloc[-1])


def test_last_costs_of_one_key_that_holds_all_rows(spark):
    rows = spark.range(20_000).selectExpr("'one' as k", "id % 7000 as ts", "id as event", "id * 0.5 as cost")
    got = evaluation.last_costs(rows, "k", ("ts", "event"), "cost", 500).collect()
    newest = sorted(((i % 7000, i) for i in range(20_000)), reverse=True)[:500]
    costs = [i * 0.5 for _, i in newest]
    assert [tuple(r) for r in got] == [("one", 500, round(sum(costs), 6), round(sum(costs) / 500, 6), costs[0])]


def test_token_usage_of_odd_replies(spark):
    replies = [('{"usage":7}', 7), ('{"usage":{"total_tokens":"12"}}', 12), ('{"usage_metadata":{"input_tokens":3}}', 3), ('{"response_metadata":{"usage":{"prompt_tokens":2,"completion_tokens":5}}}', 7), ("not json", 2), (None, 2), ("[]", 2), ('{"usage":{"total_tokens":0},"token_usage":"x"}', 2)]
    rows = spark.createDataFrame([(i, r, "12345678") for i, (r, _) in enumerate(replies)], "i int, reply string, text string")
    got = [r[1] for r in rows.select("i", t.token_usage("reply", "text").cast("long")).orderBy("i").collect()]
    assert got == [n for _, n in replies]
