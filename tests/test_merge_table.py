"""Batches merged bucket by bucket against a dictionary."""

import pytest
from pyspark.sql import DataFrameWriter

from corpusloom.operators import merge_table

SCHEMA = "k long, v string, x array<int>"


def _rows(spark, path):
    return sorted(map(tuple, merge_table.read(spark, path, SCHEMA).collect()))


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(i, f"a{i}", [i]) for i in range(200)]
    assert merge_table.merge(_df(spark, first + [(None, "no key", [])]), path, "k", "b1", n_buckets=16) == 16
    second = [(5, "b5", None), (5, "b5", [2]), (900, None, [])]
    gone = spark.createDataFrame([(7, "x"), (None, "y"), (901, "z")], "k int, other string")
    touched = merge_table.merge(_df(spark, second), path, "k", "b2", gone)
    assert 0 < touched <= 4
    want = {k: (k, v, x) for k, v, x in first} | {5: (5, "b5", [2]), 900: (900, None, [])}
    del want[7]
    assert _rows(spark, path) == sorted(want.values())
    # only the touched buckets were written, and a rerun writes nothing
    written = {r.bucket for r in spark.read.parquet(f"{path}/data/version=1").select("bucket").distinct().collect()}
    assert len(written) <= touched
    assert merge_table.merge(_df(spark, [(1, "again", [])]), path, "k", "b2") == 0
    assert _rows(spark, path) == sorted(want.values()) and merge_table.batches(spark, path) == {"b1", "b2"}
    plan = merge_table.read(spark, path, SCHEMA)._jdf.queryExecution().toString()
    assert "version" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_a_batch_that_fails_is_not_seen_and_can_be_given_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    merge_table.merge(_df(spark, [(1, "a", [1]), (2, "b", [2])]), path, "k", "b1")
    write = DataFrameWriter.parquet

    def broken(self, at, *args, **more):
        if "/manifest/" in at:
            raise OSError("lost")
        return write(self, at, *args, **more)

    monkeypatch.setattr(type(_df(spark, []).write), "parquet", broken)
    with pytest.raises(OSError):
        merge_table.merge(_df(spark, [(1, "c", [3])]), path, "k", "b2")
    monkeypatch.undo()
    assert _rows(spark, path) == [(1, "a", [1]), (2, "b", [2])]
    assert merge_table.merge(_df(spark, [(1, "c", [3])]), path, "k", "b2") == 1
    assert _rows(spark, path) == [(1, "c", [3]), (2, "b", [2])]


def test_a_bucket_can_become_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_table.merge(_df(spark, [(1, "a", [1])]), path, "k", "b1")
    merge_table.merge(_df(spark, []), path, "k", "b2", spark.createDataFrame([(1,)], "k long"))
    assert _rows(spark, path) == []
    assert merge_table.merge(_df(spark, []), path, "k", "b3") == 0 and merge_table.batches(spark, path) == {"b1", "b2", "b3"}
    merge_table.merge(_df(spark, [(1, "z", None)]), path, "k", "b4")
    assert _rows(spark, path) == [(1, "z", None)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert merge_table.merge(_df(spark, []), path, "k", "b1") == 0
    assert _rows(spark, path) == []
