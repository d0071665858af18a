"""The persisted vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, vector_index

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 1, (12, 16))
    data = middle[rng.integers(0, 12, 3000)] + rng.normal(0, 0.3, (3000, 16))
    out = [(i, v.astype(float).tolist(), i % 4) for i, v in enumerate(data)]
    out += [(5000 + i, out[7][1], None) for i in range(200)]  # a crowd of copies
    out += [(6000, [0.0] * 16, 1), (6001, None, 1), (6002, [1.0] * 15, 1), (6003, [None] + [1.0] * 15, 1), (None, out[8][1], 1), (6004, [float("nan")] * 16, 1)]
    return out


def _plain(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return vector_index.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path_factory.mktemp("index")), 16, payload="label", cells=24)


def _asked(spark, rows):
    return spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] is not None and r[0] % 100 == 7] + [(9000, [0.0] * 16), (9001, None), (9002, [1.0] * 3), (None, [1.0] * 16)], "query_id long, embedding array<float>")


def _sound(spark, rows):
    return spark.createDataFrame([r for r in rows if r[0] != 6004], SCHEMA)


@pytest.mark.parametrize("held", [vector_index.HELD, 20])
def test_exact_search_is_brute_force(spark, rows, index, monkeypatch, held):
    monkeypatch.setattr(vector_index, "HELD", held)
    got = vector_index.search(spark, index, _asked(spark, rows), 10, recall=1.0)
    want = retrieval.vector_topk(_sound(spark, rows), _asked(spark, rows).where(F.size("embedding") == 16), 10)
    assert _plain(got) == _plain(want) and len(_plain(got)) > 300


def test_payload_filter(spark, rows, index):
    got = vector_index.search(spark, index, _asked(spark, rows), 5, recall=1.0, where=["1", "2"])
    want = retrieval.vector_topk(_sound(spark, rows).where("label in (1, 2)"), _asked(spark, rows).where(F.size("embedding") == 16), 5)
    assert _plain(got) == _plain(want)


def test_audited_search_reads_fewer_cells(spark, rows, index, monkeypatch):
    read = []
    probed = vector_index._probed
    monkeypatch.setattr(vector_index, "_probed", lambda *a: read.append(int(a[4].sum())) or probed(*a))
    asked = _asked(spark, rows).where("query_id < 9000")
    got = {(q, i) for q, i, *_ in _plain(vector_index.search(spark, index, asked, 10))}
    true = {(q, i) for q, i, *_ in _plain(retrieval.vector_topk(_sound(spark, rows), asked, 10))}
    assert len(got & true) >= 0.9 * len(true)
    assert sum(read) < 0.6 * len(index.cells) * asked.count()


def test_every_row_is_indexed_and_read_back(spark, rows, index):
    again = vector_index.load(spark, index.path)
    assert (again.centroids == index.centroids).all() and (again.widest == index.widest).all()
    ids = [r.id for r in spark.read.schema(vector_index._ROWS).parquet(f"{index.path}/rows").select("id").collect()]
    assert sorted(ids) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in (6001, 6002, 6003, 6004))
    plan = spark.read.schema(vector_index._ROWS).parquet(f"{index.path}/rows").where(F.col("cell").isin(1, 2)).select("id", "code")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_empty(spark, tmp_path):
    none = vector_index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), 4)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert vector_index.search(spark, none, asked, 3).collect() == []


def test_rows_without_ids_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], SCHEMA)
    ask = spark.createDataFrame([(3, [1.0, 0.0]), (None, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert _plain(retrieval.vector_topk(v, ask, 5)) == [(3, 1, 1.0, 1)]
    docs = spark.createDataFrame([(1, "red apple"), (None, "red pear"), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(3, "red"), (None, "red")], "query_id long, text string")
    got = _plain(retrieval.bm25_topk(docs, asked, 5))
    assert [(q, i, r) for q, i, _, r in got] == [(3, 1, 1), (3, 2, 2)]
