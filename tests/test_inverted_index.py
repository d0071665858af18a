"""The inverted index against BM25 over whole texts."""

import random

import pytest

from corpusloom.operators import inverted_index, retrieval

SCHEMA = "doc_id long, text string"


def _corpus(seed: int, n: int) -> list:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(400)], k=r.randint(0, 120)))) for i in range(n)]
    rows += [(2 * n + i, rows[7][1]) for i in range(60)]  # a crowd of copies
    rows += [(3 * n, None), (3 * n + 1, ""), (3 * n + 2, "w0 " * 30_000 + "w399"), (None, "w1 w2"), (5, "w398 w398 w0"), (5, "w398")]
    return rows


def _plain(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def queries(spark):
    r = random.Random(3)
    rows = [(q, " ".join(f"w{r.randrange(400)}" for _ in range(r.randint(1, 12)))) for q in range(25)]
    return spark.createDataFrame(rows + [(90, "w0"), (91, "w398 w398"), (92, "unheard"), (93, ""), (94, None), (None, "w3"), (95, "w399 w0 w1")], "query_id long, text string")


@pytest.mark.parametrize("k", [3, 10, 200])
def test_search_is_bm25(spark, queries, tmp_path, k):
    docs = spark.createDataFrame(_corpus(1, 1500), SCHEMA)
    path = inverted_index.build(docs, str(tmp_path / "index"))
    got = _plain(inverted_index.search(spark, path, queries, k))
    assert got == _plain(retrieval.bm25_topk(docs, queries, k)) and len(got) > 25 * k


def test_refresh_is_a_new_index(spark, queries, tmp_path):
    rows = _corpus(1, 400)
    path = inverted_index.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"))
    later = [(i, t + " w398" if t and i and i % 7 == 0 else t) for i, t in rows if i is None or i % 11] + [(9000 + i, f"w{i} w399") for i in range(40)]
    docs = spark.createDataFrame(later, SCHEMA)
    moved = inverted_index.refresh(docs, path)
    assert moved["added"] == 40 and moved["removed"] == len({i for i, _ in rows if i is not None and i % 11 == 0}) and moved["changed"] > 40
    assert _plain(inverted_index.search(spark, path, queries, 10)) == _plain(retrieval.bm25_topk(docs, queries, 10))
    # ids that come back, in a third generation; an unchanged table writes none
    back = spark.createDataFrame(rows, SCHEMA)
    inverted_index.refresh(back, path)
    assert _plain(inverted_index.search(spark, path, queries, 10)) == _plain(retrieval.bm25_topk(back, queries, 10))
    assert inverted_index.refresh(back, path) == {"added": 0, "changed": 0, "removed": 0}
    assert inverted_index.generations(spark, path) == [0, 1, 2]


def test_only_changed_rows_are_indexed(spark, tmp_path):
    rows = [(i, f"w{i} w{i % 5}") for i in range(200)]
    path = inverted_index.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"))
    rows[17] = (17, "other words")
    inverted_index.refresh(spark.createDataFrame(rows, SCHEMA), path)
    assert [r.id for r in spark.read.parquet(f"{path}/docs/gen=1").select("id").collect()] == [17]
    assert [r.id for r in spark.read.parquet(f"{path}/dead/gen=1").collect()] == [17]


def test_a_broken_refresh_is_not_read_and_done_again(spark, queries, tmp_path, monkeypatch):
    rows = _corpus(2, 200)
    docs = spark.createDataFrame(rows, SCHEMA)
    path = inverted_index.build(docs, str(tmp_path / "index"))
    later = spark.createDataFrame([(i, (t or "") + " w397") for i, t in rows[:150]], SCHEMA)
    kept = inverted_index._bucket

    def broken():
        raise OSError("lost")

    monkeypatch.setattr(inverted_index, "_bucket", broken)
    with pytest.raises(OSError):
        inverted_index.refresh(later, path)
    monkeypatch.setattr(inverted_index, "_bucket", kept)
    assert _plain(inverted_index.search(spark, path, queries, 5)) == _plain(retrieval.bm25_topk(docs, queries, 5))
    inverted_index.refresh(later, path)
    assert _plain(inverted_index.search(spark, path, queries, 5)) == _plain(retrieval.bm25_topk(later, queries, 5))


def test_fewer_blocks_are_read_than_held(spark, tmp_path):
    docs = spark.createDataFrame(_corpus(4, 6000), SCHEMA)
    path = inverted_index.build(docs, str(tmp_path / "index"))
    asked = spark.createDataFrame([(q, f"w{q} w{300 + q}") for q in range(10)], "query_id long, text string")
    counts = inverted_index.blocks_read(spark, path, asked, 5).collect()
    assert len(counts) == 10 and all(0 < r["read"] <= r["held"] for r in counts)
    assert sum(r["read"] for r in counts) < 0.5 * sum(r["held"] for r in counts)
    held = spark.read.schema(inverted_index._BLOCKS).parquet(f"{path}/blocks").where("gen = 0 and zone in (1)")
    assert "PartitionFilters: [isnotnull(gen" in held._jdf.queryExecution().toString()


def test_empty(spark, queries, tmp_path):
    none = inverted_index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert inverted_index.search(spark, none, queries, 3).collect() == []
    docs = spark.createDataFrame([(1, "w0 w1")], SCHEMA)
    inverted_index.refresh(docs, none)
    assert _plain(inverted_index.search(spark, none, queries, 3)) == _plain(retrieval.bm25_topk(docs, queries, 3))
