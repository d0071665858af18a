"""Lloyd's centroid clustering with two trees, exact in whole numbers.

Vectors stay where they lie: a task puts up to ``SHARD_ROWS`` of them into one cover tree,
whose nodes know the range of their vectors, and the trees are written once. In each round
the centroids, a bounded number, form a cover tree of their own. Both trees are descended
together. A pair of nodes is dropped when its least possible distance exceeds the largest
that the vector node can have to its best centroid; where one centroid is left, the whole
node is assigned by its sum and count; pairs of leaves are compared in whole numbers. A
task returns one row of sums a centroid, Spark adds them, and the driver sees only
``clusters`` rows, so a crowd of equal vectors costs one node and nothing is shuffled by
its cluster.

A component x counts as floor(scale * x), x in double precision. Vectors of another length,
null ones, those that hold null or non-finite components, and those with a component
beyond 2**27 after scaling, whose squared distances a long cannot hold, are left out. A
null vec_id keeps its row but starts no centroid; rows that repeat a vec_id count
separately, and of equal start hashes the smaller vector comes first. With fewer vectors
than clusters there are fewer centroids. Sums beyond a long are null. An empty table
gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

#: Vectors in one tree. A task makes as many trees as its rows need.
SHARD_ROWS = 4096
#: Vectors in a leaf, point pairs compared at a time, and the largest component.
LEAF, PAIRS, LARGEST = 24, 1 << 16, 1 << 27


class CoverTree:
    """A cover tree over integer points: children of a node lie within its level's radius
    of its point and further apart than half of that from each other. Points are kept in
    the order of the tree, so a node is the range ``lo`` to ``hi``, its point first."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        order, data = np.arange(n), points.astype(np.float64)
        far = np.zeros(n)  # distance to the point of the node that holds it
        if n:
            far[:] = _apart(data, data[0])
        lo, hi, radius, first, last = [0], [n], [float(far.max(initial=0))], [0], [0]
        at = 0
        while at < len(lo):
            a, b, r = lo[at], hi[at], radius[at]
            first[at] = last[at] = len(lo)
            if b - a > leaf and r > 0:
                reach = 2.0 ** (np.ceil(np.log2(r)) - 1)
                if reach >= r:
                    reach /= 2
                rest, away, groups = order[a:b], far[a:b], []
                near = away <= reach
                groups.append((rest[near], away[near]))
                rest = rest[~near]
                while len(rest):
                    away = _apart(data[rest], data[rest[0]])
                    near = away <= reach
                    groups.append((rest[near], away[near]))
                    rest = rest[~near]
                for inside, away in groups:
                    order[a : a + len(inside)], far[a : a + len(inside)] = inside, away
                    lo.append(a)
                    a += len(inside)
                    hi.append(a)
                    radius.append(float(away.max()))
                    first.append(0)
                    last.append(0)
                last[at] = len(lo)
            at += 1
        self.order = order
        self.points = points[order]
        self.lo, self.hi, self.radius, self.first, self.last = (np.array(x) for x in (lo, hi, radius, first, last))

    @property
    def leaf(self) -> np.ndarray:
        return self.first == self.last

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, child) of all children."""
        n = self.last[nodes] - self.first[nodes]
        return np.repeat(np.arange(len(nodes)), n), _ranges(self.first[nodes], n)


def _apart(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    step = rows - point
    return np.sqrt(np.einsum("ij,ij->i", step, step))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] times, for every i."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def assign(vectors: CoverTree, centroids: CoverTree, numbers: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Whole nodes as (lo, hi, place of the centroid), and the other points with theirs.

    ``numbers`` are the centroids' numbers in the order of their tree; of equally near
    centroids the smaller number wins.
    """
    v, c = vectors, centroids
    vp, cp = v.points[v.lo].astype(np.float64), c.points[c.lo].astype(np.float64)
    whole: list[tuple[int, int, int]] = []
    points, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    q, k = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # pairs of nodes, those of a vector node together
    while len(q):
        apart = np.concatenate([_apart(vp[q[i : i + PAIRS]], cp[k[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)])
        slack = 1e-9 * (1 + apart + v.radius[q] + c.radius[k])
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(q)))
        best = np.minimum.reduceat(apart + v.radius[q] + slack, starts)
        keep = apart - v.radius[q] - c.radius[k] - slack <= best[group]
        q, k, group = q[keep], k[keep], group[keep]
        sizes = np.bincount(group)[group]
        split = ~c.leaf[k] & ((c.radius[k] >= v.radius[q]) | v.leaf[q])
        waits = np.zeros(len(starts), dtype=bool)
        waits[group[split]] = True
        done = (sizes == 1) & c.leaf[k] & (c.hi[k] - c.lo[k] == 1)
        whole.extend(zip(v.lo[q[done]].tolist(), v.hi[q[done]].tolist(), c.lo[k[done]].tolist()))
        compare = ~done & ~waits[group] & v.leaf[q]
        if compare.any():
            found = _compare(v, c, numbers, q[compare], k[compare])
            points.append(found[0])
            places.append(found[1])
        descend = ~done & ~waits[group] & ~v.leaf[q]
        stay = waits[group] & ~split
        i, down = c.children(k[split])
        j, below = v.children(q[descend])
        q, k = np.concatenate([q[split][i], q[stay], below]), np.concatenate([down, k[stay], k[descend][j]])
        together = np.argsort(q, kind="stable")
        q, k = q[together], k[together]
    return whole, np.concatenate(points), np.concatenate(places)


def _compare(v: CoverTree, c: CoverTree, numbers: np.ndarray, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the leaves' centroids for every point of the leaves."""
    n, m = v.hi[q] - v.lo[q], c.hi[k] - c.lo[k]
    pair = np.repeat(np.arange(len(q)), n * m)
    inside = _ranges(np.zeros(len(q), dtype=np.int64), n * m)
    point, place = v.lo[q][pair] + inside // m[pair], c.lo[k][pair] + inside % m[pair]
    square = np.concatenate([np.zeros(0, dtype=np.int64), *(squared(v.points[point[i : i + PAIRS]], c.points[place[i : i + PAIRS]]) for i in range(0, len(point), PAIRS))])
    order = np.lexsort((numbers[place], square, point))
    first = order[np.flatnonzero(np.diff(point[order], prepend=-1))]
    return point[first], place[first]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = a - b
    return np.einsum("ij,ij->i", step, step)


def _shards(dims: int):
    """(ids, tree): pickled ids in the order of the tree, null ones as None, and the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            points = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dims)
            tree = CoverTree(points)
            ids = rows.column(0).to_numpy(zero_copy_only=False) if not rows.column(0).null_count else np.array(rows.column(0).to_pylist(), dtype=object)
            tree.points = tree.points.astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ids[tree.order])], pa.binary()), pa.array([pickle.dumps(tree)], pa.binary())], names=["ids", "tree"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, SHARD_ROWS - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == SHARD_ROWS:
                    yield shard()
                    held, n = [], 0
        if n:
            yield shard()

    return run


def _unpickled(tree: bytes) -> CoverTree:
    found = pickle.loads(tree)
    found.points = found.points.astype(np.int64)
    return found


def _sums(centroids: np.ndarray):
    """(cluster, n, total): for each tree and centroid, how many vectors and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = CoverTree(centroids, 1)
        for batch in batches:
            for tree in batch.column(1):
                v = _unpickled(tree.as_py())
                upto = np.concatenate([np.zeros((1, v.points.shape[1]), dtype=np.int64), np.cumsum(v.points, axis=0)])
                n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
                whole, points, places = assign(v, c, c.order)
                for lo, hi, place in whole:
                    n[c.order[place]] += hi - lo
                    total[c.order[place]] += upto[hi] - upto[lo]
                np.add.at(n, c.order[places], 1)
                np.add.at(total, c.order[places], v.points[points])
                on = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(n[on]), pa.array(total[on].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _members(centroids: np.ndarray):
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = CoverTree(centroids, 1)
        for batch in batches:
            for ids, tree in zip(batch.column(0), batch.column(1)):
                v = _unpickled(tree.as_py())
                place = np.zeros(len(v.points), dtype=np.int64)
                whole, points, places = assign(v, c, c.order)
                for lo, hi, at in whole:
                    place[lo:hi] = at
                place[points] = places
                yield pa.RecordBatch.from_arrays([pa.array(pickle.loads(ids.as_py()).tolist(), pa.int64()), pa.array(c.order[place].astype(np.int32)), pa.array(squared(v.points, c.points[place]))], names=["vec_id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): the vectors that are kept, in whole numbers."""
    x = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    sound = x.isNotNull() & (F.size(x) == dims) & F.coalesce(~F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) * scale >= LARGEST)), F.lit(False))
    return rows.where(sound).select("vec_id", F.transform(x, lambda y: F.floor(y * scale).cast("long")).alias("v"))


def lloyd(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale, id_column, vector_column)
    start = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "v").select("v").limit(clusters).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r[0] for r in start], dtype=np.int64)
    trees = cut(spread(rows).mapInArrow(_shards(dims), "ids binary, tree binary"))
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
        total = F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dims)])
        for cluster, n, added in sums.groupBy("cluster").agg(F.sum("n"), total).collect():  # a row a centroid
            centroids[cluster] = [int(x) // n for x in added]
    members = cut(trees.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"))
    marks = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    of_cluster = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    whole = of_cluster.agg(F.sum("part").try_cast("long").alias("inertia"))
    told = of_cluster.select("cluster", F.col("part").try_cast("long").alias("cluster_inertia")).join(F.broadcast(marks), "cluster").crossJoin(F.broadcast(whole))
    return members.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
