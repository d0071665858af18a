"""Near-duplicate embeddings by navigable small-world graphs, one a shard.

Vectors of a label are dealt to shards of at most about ``SHARD_ROWS``. A shard first puts
each vector into the ball of the nearest leader within half the link angle, or makes it a
leader; the leaders form the shard's hierarchical graph, which is also what finds the
nearest leader. All pairs inside a ball link, since two half angles make a whole one. Then
the leaders of every shard query the graph of every shard of the label. By the triangle
inequality two balls link as a whole, not at all, or need their members' cosines, which
are computed in double precision. So a crowd of near copies costs one ball, not its pairs.

For each pair of shards a sample of queries is answered by brute force as well; until at
least ``RECALL`` of what it finds is found, the beam is doubled, at last to the whole
shard. A task emits link counts and the edges of a spanning forest; components are then
united over all shards. Equal vectors are merged before anything else.

Vectors that are null, zero, or hold null or non-finite components, and rows with null
label or vec_id, link with nothing: n_links 0, a component of their own. Vectors of
different length never link. Rows that repeat a vec_id count as separate vectors.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

COSINE = 0.93
SHARD_ROWS = 16384
#: Links of a node on the upper layers, twice as many on the lowest.
LINKS = 12
BEAM_BUILD, BEAM_QUERY = 48, 32
#: Share of true links that an audit must find, and of nearest neighbours where the
#: audited queries have fewer than ``FEW`` links.
RECALL, RECALL_NEAREST, AUDITED, FEW = 0.98, 0.9, 256, 16


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, dim: int, seed: int = 5):
        self.data = np.zeros((64, dim))
        self.n, self.top, self.entry = 0, -1, -1
        self.layers: list[dict[int, np.ndarray]] = []
        self.rng = np.random.default_rng(seed)

    def _beam(self, q: np.ndarray, starts: list[tuple[float, int]], beam: int, layer: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest nodes found from ``starts``, as (similarity, node)."""
        links, data = self.layers[layer], self.data
        seen = np.zeros(self.n, dtype=bool)
        seen[[i for _, i in starts]] = True
        todo = [(-s, i) for s, i in starts]
        best = list(starts)
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= beam:
                break
            near = links[i]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            sims = data[near] @ q
            if len(best) >= beam:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for s, j in zip(sims.tolist(), near.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                else:
                    continue
                heapq.heappush(todo, (-s, j))
        return best

    def _descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.data[self.entry] @ q), self.entry)]
        for layer in range(self.top, to, -1):
            at = self._beam(q, at, 1, layer)
        return at

    def search(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        if not self.n:
            return []
        return self._beam(q, self._descend(q, 0), beam, 0)

    def _spread_out(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to each other come first."""
        kept: list[int] = []
        rest: list[int] = []
        for s, i in sorted(found, reverse=True):
            if len(kept) >= most:
                break
            if kept and (self.data[kept] @ self.data[i]).max() > s:
                rest.append(i)
            else:
                kept.append(i)
        return np.array((kept + rest)[:most], dtype=np.int32)

    def add(self, q: np.ndarray) -> int:
        if self.n == len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        node, level = self.n, int(-math.log(1 - self.rng.random()) / math.log(LINKS))
        self.data[node] = q
        self.n += 1
        at = self._descend(q, min(level, self.top)) if node else []
        for layer in range(level, -1, -1):
            while len(self.layers) <= layer:
                self.layers.append({})
            links, most = self.layers[layer], LINKS if layer else 2 * LINKS
            if layer > self.top:
                links[node] = np.zeros(0, dtype=np.int32)
                continue
            at = self._beam(q, at, BEAM_BUILD, layer)
            links[node] = self._spread_out(at, LINKS)
            for other in links[node].tolist():
                joined = np.append(links[other], np.int32(node))
                if len(joined) > most:
                    joined = self._spread_out(list(zip((self.data[joined] @ self.data[other]).tolist(), joined.tolist())), most)
                links[other] = joined
        if level > self.top:
            self.top, self.entry = level, node
        return node


class Shard:
    """Balls of vectors around leaders, and the leaders' graph."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, cosine: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.counts = ids[order], counts[order]
        raw = vectors[order].astype(np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        self.unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        half = math.cos(math.acos(cosine) / 2 - 1e-7)
        self.graph, members = Graph(raw.shape[1]), []
        for i, q in enumerate(self.unit):
            near = max(self.graph.search(q, 8), default=(-1.0, -1))
            if near[0] >= half:
                members[near[1]].append(i)
            else:
                self.graph.add(q)
                members.append([i])
        self.members = [np.array(m) for m in members]
        self.angle = np.array([_angles(self.unit[m] @ self.unit[m[0]]).max() for m in self.members]) if members else np.zeros(0)
        self.graph.data = self.graph.data[: self.graph.n]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _near_leaders(a: Shard, b: Shard, theta: float) -> list[list[int]]:
    """For each leader of ``a`` the leaders of ``b`` whose balls may link with its own."""
    reach = np.cos(np.minimum(np.pi, theta + a.angle + b.angle.max() + 1e-7))
    audit = np.unique(np.linspace(0, a.graph.n - 1, AUDITED).astype(int))
    exact = a.graph.data[audit] @ b.graph.data.T
    beam = BEAM_QUERY

    def query(i: int) -> list[int]:
        q, width = a.graph.data[i], beam
        while True:
            if width >= b.graph.n:
                return np.flatnonzero(b.graph.data @ q >= reach[i]).tolist()
            found = b.graph.search(q, width)
            if min(found)[0] < reach[i]:  # the beam reaches past all that may link
                return [j for s, j in found if s >= reach[i]]
            width *= 2

    truth = []
    for i, row in zip(audit.tolist(), exact):
        if a is b:  # its own copy in the same shard is no test
            row[i] = -2.0
        truth.append((i, set(np.flatnonzero(row >= reach[i]).tolist()), float(row.max())))
    wanted = sum(len(true) for _, true, _ in truth)
    while beam < b.graph.n:
        if wanted >= FEW:
            hit = sum(len(true.intersection(query(i))) for i, true, _ in truth if true)
            passed = hit >= RECALL * wanted
        else:
            some = truth[:: max(1, len(truth) // 64)]
            near = [max((x for x in b.graph.search(a.graph.data[i], beam) if a is not b or x[1] != i), default=(-2.0, -1))[0] >= top - 1e-12 for i, _, top in some]
            passed = all(true <= set(query(i)) for i, true, _ in truth if true) and sum(near) >= RECALL_NEAREST * len(near)
        if passed:
            break
        beam *= 2
    return [query(i) for i in range(a.graph.n)]


class _Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        roots = []
        for x in (a, b):
            while (p := self.parent.get(x, x)) != x:
                self.parent[x] = self.parent.get(p, p)
                x = p
            roots.append(x)
        if roots[0] != roots[1]:
            self.parent[max(roots)] = min(roots)
            self.edges.append((a, b))


def link(a: Shard, b: Shard, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each member of ``a`` and of ``b`` into the other, and a spanning forest.
    With a shard itself, the links of its members to each other in the first array."""
    theta = math.acos(cosine)
    into_a, into_b = np.zeros(len(a.ids), dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64)
    forest = _Forest()
    if a is b:
        for m in a.members:
            into_a[m] += a.counts[m].sum() - a.counts[m]
            for other in m[1:].tolist():
                forest.join(int(a.ids[m[0]]), int(a.ids[other]))
    for i, near in enumerate(_near_leaders(a, b, theta)):
        for j in near:
            if a is b and j <= i:
                continue
            m, k = a.members[i], b.members[j]
            apart = float(_angles(a.graph.data[i] @ b.graph.data[j]))
            if apart > theta + a.angle[i] + b.angle[j] + 1e-7:
                continue
            if apart + a.angle[i] + b.angle[j] < theta - 1e-7:
                into_a[m] += b.counts[k].sum()
                into_b[k] += a.counts[m].sum()
                forest.join(int(a.ids[m[0]]), int(b.ids[k[0]]))
                continue  # each shard with itself has tied its balls together
            for first in range(0, len(m), 512):
                part = m[first : first + 512]
                on = a.unit[part] @ b.unit[k].T >= cosine
                into_a[part] += on @ b.counts[k]
                into_b[k] += a.counts[part] @ on
                rows, cols = on.any(axis=1), on.any(axis=0)
                for x in part[rows].tolist():
                    forest.join(int(a.ids[x]), int(b.ids[k[int(on[int(np.searchsorted(part, x))].argmax())]]))
                for y in np.flatnonzero(cols).tolist():
                    forest.join(int(a.ids[part[int(on[:, y].argmax())]]), int(b.ids[k[y]]))
    return into_a, into_b, forest.edges


_LINKS = "a long, b long, n long"


def _build(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()), cosine)
        return pd.DataFrame({"space": pdf["space"].iloc[:1], "shard": pdf["shard"].iloc[:1], "graph": [pickle.dumps(shard)]})

    return run


def _query(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for one, other, x, y in zip(pdf["one"], pdf["other"], pdf["x"], pdf["y"]):
            a = pickle.loads(x)
            b = a if one == other else pickle.loads(y)
            into_a, into_b, edges = link(a, b, cosine)
            if a is b:
                into_a = into_a + into_b
            for shard, n in ((a, into_a), *(((b, into_b),) if a is not b else ())):
                on = np.flatnonzero(n)
                out.append(pd.DataFrame({"a": shard.ids[on], "b": pd.array([None] * len(on), dtype="Int64"), "n": pd.array(n[on], dtype="Int64")}))
            out.append(pd.DataFrame({"a": [e[0] for e in edges], "b": pd.array([e[1] for e in edges], dtype="Int64"), "n": pd.array([None] * len(edges), dtype="Int64")}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS, id_column: str = "vec_id", vector_column: str = "embedding", group_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(group_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("embedding"))
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~broken & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("space", F.when(F.coalesce(ok, F.lit(False)), F.concat_ws("/", F.size("embedding").cast("string"), "label")))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    classes = cut(rows.where("space is not null").groupBy("space", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))

    shards = classes.groupBy("space").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = classes.join(shards, "space").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    graphs = cut(dealt.select("space", "shard", "rep", "n", "embedding").groupBy("space", "shard").applyInPandas(_build(cosine), "space string, shard int, graph binary"))
    left = graphs.select("space", F.col("shard").alias("one"), F.col("graph").alias("x"))
    # a shard is its own partner without a second copy of its graph
    right = graphs.select("space", F.col("shard").alias("other"), F.col("graph").alias("y"))
    crossed = left.join(right, "space").where("one < other")
    itself = left.select("space", "one", "x", F.col("one").alias("other"), F.lit(None).cast("binary").alias("y"))
    pairs = crossed.select("space", "one", "x", "other", "y").unionByName(itself)
    found = cut(pairs.groupBy("space", "one", "other").applyInPandas(_query(cosine), _LINKS))

    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "rep")
    groups = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = classes.select("space", "h1", "h2", "rep", "n").join(counts, "rep", "left").join(groups, "rep", "left").select("space", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "space", "h1", "h2").join(known, ["space", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
