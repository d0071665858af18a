"""Dual-tree clustering against plain Lloyd, and its edge cases."""

import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import dual_tree

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string"


def _plain(rows, dims, clusters=16, rounds=3, scale=64, seed=1):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centroids = [v for _, v in start]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((apart(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in set(own):
            of = [v for (_, v), o in zip(kept, own) if o == k]
            centroids[k] = [sum(x) // len(of) for x in zip(*of)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in found)
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, sum(e for _, j, e in found if j == k), total, mark[k]) for i, k, d in found), key=repr)


def _vectors(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (5, dims))
    return (middle[rng.integers(0, 5, n)] + rng.normal(0, spread, (n, dims))).astype(np.float32)


@pytest.mark.parametrize("spread,shard", [(0.01, 4096), (0.5, 64), (3.0, 200)])
def test_same_as_plain_lloyd(spark, monkeypatch, spread, shard):
    monkeypatch.setattr(dual_tree, "SHARD_ROWS", shard)
    rows = [(i, v.tolist(), 1, "x", "y") for i, v in enumerate(_vectors(500, 8, 3, spread))]
    rows += [(7, rows[7][1], 1, "x", "y"), (None, rows[8][1], 1, "x", "y")] + [(1000 + i, rows[9][1], None, None, None) for i in range(300)]
    rows += [(2000, None, 1, "", ""), (2001, [1.0] * 7, 1, "", ""), (2002, [None] + [1.0] * 7, 1, "", ""), (2003, [float("nan")] * 8, 1, "", ""), (2004, [float("inf")] * 8, 1, "", ""), (2005, [0.0] * 8, 1, "", ""), (2006, [3e30] * 8, 1, "", "")]
    got = dual_tree.lloyd(spark.createDataFrame(rows, SCHEMA), dims=8)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain([r for r in rows if r[0] != 2006], 8)


def test_few_vectors_and_ties(spark):
    rows = [(3, [0.0, 0.0]), (5, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    got = dual_tree.lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dims=2)
    assert sorted(map(tuple, got.collect())) == _plain(rows, 2)
    assert dual_tree.lloyd(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert dual_tree.lloyd(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_tree_covers_its_points_and_prunes():
    points = np.floor(64 * _vectors(3000, 16, 1, 0.02)).astype(np.int64)
    tree = dual_tree.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(3000)) and (tree.points == points[tree.order]).all()
    for lo, hi, r, first, last in zip(tree.lo, tree.hi, tree.radius, tree.first, tree.last):
        assert np.sqrt(dual_tree.squared(tree.points[lo:hi], tree.points[lo])).max() <= r + 1e-9
        if first < last:
            assert tree.lo[first] == lo and tree.hi[last - 1] == hi
    centroids = dual_tree.CoverTree(points[:16], 1)
    whole, compared, _ = dual_tree.assign(tree, centroids, centroids.order)
    assert sum(hi - lo for lo, hi, _ in whole) + len(compared) == 3000
    assert sum(hi - lo for lo, hi, _ in whole) > 0
