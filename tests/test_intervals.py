"""The interval join against a plain loop."""

import random

from corpusloom.operators import intervals

POINTS, RANGES = "path string, line int, note string", "path string, first int, last int, name string"


def _innermost(spark, points, ranges):
    df = intervals.innermost(spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), ["path"], "line", "first", "last", ["name"])
    return sorted(map(tuple, df.select("path", "line", "note", "first", "last", "name").collect()), key=repr)


def _plain(points, ranges):
    out = []
    for path, line, note in points:
        around = [(f, -l, n) for p, f, l, n in ranges if None not in (path, line, p, f, l) and p == path and f <= line <= l]
        f, l, n = max(around, default=(None, 0, None))
        out.append((path, line, note, f, -l if f is not None else None, n))
    return sorted(out, key=repr)


def test_against_a_loop(spark):
    r = random.Random(5)
    ranges = []
    for i in range(300):
        first = r.randint(-20, 3000)
        ranges.append((r.choice("ab"), first, first + int(2 ** r.uniform(0, 11)) - 1, f"s{i:03}"))
    ranges += [("a", 0, 2**31 - 2, "whole"), ("b", 7, 6, "turned"), ("a", None, 9, "x"), (None, 1, 9, "x"), ("a", 64, 127, "even"), ("a", 64, 127, "even")]
    points = [(r.choice("abc"), r.randint(-40, 6000), f"n{i}") for i in range(900)]
    points += [("a", 64, "edge"), ("a", 127, "edge"), ("a", 127, "edge"), (None, 5, "x"), ("a", None, "x"), ("a", 2**31 - 2, "far")]
    assert _innermost(spark, points, ranges) == _plain(points, ranges)


def test_empty(spark):
    assert _innermost(spark, [], [("a", 1, 2, "s")]) == []
    assert _innermost(spark, [("a", 1, "n")], []) == [("a", 1, "n", None, None, None)]


def test_a_range_lies_in_two_bins_at_most(spark):
    ranges = spark.createDataFrame([("a", 1, 2**30, "long"), ("a", 3, 3, "short")], RANGES)
    found = intervals.innermost(spark.createDataFrame([("a", i, "n") for i in (2, 3, 4)], POINTS), ranges, ["path"], "line", "first", "last", ["name"])
    assert {(r.line, r.name) for r in found.collect()} == {(2, "long"), (3, "short"), (4, "long")}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
