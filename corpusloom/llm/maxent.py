"""Language-model scores of texts: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class after the tokens before it, times its own within
the class. Classes see hashed features of the word before, of the two before, and of the one
two back alone; words within a class see that of the word before.
Words without weights of their own form a class that is told apart by counts alone. Features
are one-hot, so a batch of tokens is scored by summing rows of two tables, in sparse numpy
batches.

1. Tokens of all training texts are counted, and the counts stay a table. Only the ``TOP``
   most frequent words, a bounded number, are known to every task; counts of all others
   are looked up by a join, which has no frequent key for that reason.
2. Every text is written once as ids of those words and the hashes of its other words.
3. Classes are clusters of the ``WORDS`` most frequent words by the frequent words that
   precede them, counted over all training texts.
4. Training takes each training text once, in ``len(SHARES)`` rounds. In a round every task
   descends the gradient over its own texts from the same weights; what its weights gained
   is summed up by blocks, weighted by how often each row was used, in two levels.
5. Scoring is one map over the ids.

Words are told apart by 96 bits of a hash. Gains are added in whole numbers, so the model
does not depend on their order, but it does depend on which texts lie in one task. A null
or empty text has its end only. Texts of any length are read whole. A null doc_id trains.
Rows that repeat count each. Without training texts all scores are 0; an empty table gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread, staged

#: Words whose counts and ids every task holds, and those that have weights of their own.
TOP, WORDS = 65_534, 2048
#: Frequent words that tell classes apart, tokens that they reach, and clusters to begin with.
ANCHORS, REACH, CLUSTERS = 63, 6, 32
#: Rows of hashed features of classes and of words.
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 8
#: Parts of the training texts that each round takes, in 16ths.
SHARES = (4, 12)
#: Tokens of a task's first gradient step, of any step, of one shuffled stretch, and of a
#: training task where the cluster has fewer cores than the texts need.
FIRST, STEP, STRETCH, TASK = 512, 32_768, 1 << 18, 1 << 24
#: Step size, and how many uses hold a rare row back.
RATE, PRIOR = 1.2, 6.0
#: Rows of one block of gains.
CLASS_BLOCK, WORD_BLOCK = 256, 8
#: Distinct words that a task counts, or knows, before it passes them on.
HELD = 1 << 18

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_OTHER, _NONE = TOP, TOP + 1
_UNIT = 1 << 20


def tokens(text: str | None) -> list[bytes]:
    """The lower-cased words of a text and its end, which is an empty word."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    found.append(b"")
    return found


def _mark(word: bytes) -> bytes:
    """The 96 bits by which words are told apart."""
    return xxhash.xxh3_128_digest(word)[:12]


def _halves(marks: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """The marks as longs and ints."""
    both = np.frombuffer(b"".join(marks), dtype=[("h", "<i8"), ("g", "<i4")])
    return pa.array(both["h"]), pa.array(both["g"])


def held_out(doc_id: int | None) -> bool:
    """crc32 of doc_id as text leaves 2 when divided by 7."""
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % 7 == 2


def _count_map():
    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*_halves(list(map(_mark, held))), pa.array(list(held.values()), pa.int64())], names=["h", "g", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if not held_out(doc_id.as_py()):
                    held.update(tokens(text.as_py()))
                    if len(held) >= HELD:
                        yield rows(held)
                        held = Counter()
        yield rows(held)

    return run


class _Ids(dict):
    """Ids of words by their bytes, looked up by their mark when a word is first met."""

    def __init__(self, marks: list[bytes], other: int):
        super().__init__()
        self.known, self.other = {m: i for i, m in enumerate(marks)}, other

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = found = self.known.get(_mark(word), self.other)
        return found


_ENCODED = "row long, doc_id long, held boolean, n_tokens long, n_top long, own double, rest double, ids binary, h array<long>, g array<int>, n array<long>"


def _encode_map(top):
    """A row a text: ids of its tokens, sums of log10(count + 1) over words with weights of
    their own and over other known words, and the hashes and counts of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, logs = top.value
        number = _Ids(marks, _OTHER).__getitem__
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[] for _ in range(8)]
                rest: list[bytes] = []
                counts: list[int] = []
                ends = [0]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = tokens(text.as_py())
                    ids = np.fromiter(map(number, words), dtype=np.uint16, count=len(words))
                    inside = ids != _OTHER
                    others = Counter(map(words.__getitem__, np.flatnonzero(~inside).tolist()))
                    rest.extend(map(_mark, others))
                    counts.extend(others.values())
                    ends.append(len(rest))
                    mine = ids[inside]
                    lg, own = logs[mine], mine < WORDS
                    for column, value in zip(out, (row, doc_id, held_out(doc_id), len(words), len(mine), float(lg[own].sum()), float(lg[~own].sum()), ids.tobytes())):
                        column.append(value)
                    row += 1
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (*_halves(rest), pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), *lists], names=[f.split()[0] for f in _ENCODED.split(", ")])

    return run


def _contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All ids, and for each of them those one and two places before in its text."""
    flat = np.concatenate(ids).astype(np.int64)
    sizes = np.array([len(x) for x in ids])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = []
    for k in (1, 2):
        b = np.full(len(flat), _NONE, dtype=np.int64)
        b[k:] = flat[:-k]
        b[place < k] = _NONE
        before.append(b)
    return flat, before


def _hashed(rows: int, salt: int, *parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), salt * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
        for x in parts:
            h = (h ^ x.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return (h % np.uint64(rows)).astype(np.int32)


class Model:
    """Two tables of weights over counts: ``counts`` of the words, most frequent first, and
    ``rest``, the counts of all others, of which one is the unknown word."""

    def __init__(self, counts: np.ndarray, rest: float, kind: np.ndarray):
        order = np.argsort(kind, kind="stable")
        self.slot = np.empty(len(order), dtype=np.int32)
        self.slot[order] = np.arange(len(order))
        self.classes = int(kind.max(initial=-1)) + 1
        self.start = np.searchsorted(kind[order], np.arange(self.classes + 1))
        self.kind = np.append(kind, self.classes).astype(np.int32)  # the last class is the rest
        mass = np.append(np.bincount(kind, counts + 1, self.classes), rest)
        self.class_bias, self.word_bias = np.log(mass / mass.sum()).astype(np.float32), np.log(counts[order] + 1).astype(np.float32)
        self.by_class = np.zeros((CLASS_ROWS, self.classes + 1), dtype=np.float32)
        self.by_word = np.zeros((WORD_ROWS, len(order)), dtype=np.float32)

    def features(self, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of either table, as (feature, token)."""
        a, b = before
        return np.stack([_hashed(CLASS_ROWS, 1, a), _hashed(CLASS_ROWS, 2, a, b), _hashed(CLASS_ROWS, 3, b)]), _hashed(WORD_ROWS, 4, a)[None]

    def _softmax(self, logits: np.ndarray) -> np.ndarray:
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def _summed(self, table: np.ndarray, rows: np.ndarray, bias: np.ndarray, span: slice = slice(None)) -> np.ndarray:
        table = table[:, span]
        logits = np.take(table, rows[0], axis=0)
        for r in rows[1:]:
            logits += np.take(table, r, axis=0)
        logits += bias[span]
        return logits

    def _grouped(self, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, its tokens) of classes of more than one word."""
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.classes + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            if self.start[k + 1] - self.start[k] > 1:
                yield k, order[ends[k] : ends[k + 1]]

    def log_probabilities(self, ids: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Natural logarithms; for a word of the rest that of its class."""
        target = np.minimum(ids, len(self.slot))
        kind = self.kind[target]
        p = self._softmax(self._summed(self.by_class, rows[0], self.class_bias))
        out = np.log(np.maximum(p[np.arange(len(ids)), kind], 1e-30)).astype(np.float64)
        for k, some in self._grouped(kind):
            span = slice(self.start[k], self.start[k + 1])
            p = self._softmax(self._summed(self.by_word, rows[1][:, some], self.word_bias, span))
            out[some] += np.log(np.maximum(p[np.arange(len(some)), self.slot[target[some]] - span.start], 1e-30))
        return out

    def step(self, ids: np.ndarray, rows: tuple[np.ndarray, np.ndarray], rate: float, used: tuple[np.ndarray, np.ndarray]) -> None:
        """One gradient step; ``used`` counts the uses of rows, of words by their class."""
        target = np.minimum(ids, len(self.slot))
        kind = self.kind[target]
        p = self._softmax(self._summed(self.by_class, rows[0], self.class_bias))
        p[np.arange(len(ids)), kind] -= 1
        self._descend(self.by_class, slice(None), rows[0], p, rate, used[0], 0)
        for k, some in self._grouped(kind):
            span = slice(self.start[k], self.start[k + 1])
            p = self._softmax(self._summed(self.by_word, rows[1][:, some], self.word_bias, span))
            p[np.arange(len(some)), self.slot[target[some]] - span.start] -= 1
            self._descend(self.by_word, span, rows[1][:, some], p, rate, used[1], k)

    @staticmethod
    def _descend(table: np.ndarray, span: slice, rows: np.ndarray, slope: np.ndarray, rate: float, used: np.ndarray, column: int) -> None:
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        which, n = flat[order[starts]], np.diff(starts, append=len(flat))
        total = _group_sums(slope, order % len(slope), starts, n)
        table[which, span] -= total * (rate / (n + PRIOR))[:, None].astype(np.float32)
        used[which, column] += n


def _group_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order`` of ``values`` by groups of n that begin at ``starts``."""
    if len(order) < 4096:
        return np.add.reduceat(values[order], starts, axis=0)
    # large groups one by one; of the others the first rows, the second rows and so on at once
    by = np.argsort(-n, kind="stable")
    first, size = starts[by], n[by]
    out = np.zeros((len(by), values.shape[1]), dtype=values.dtype)
    large = int(np.searchsorted(-size, -24))
    for i in range(large):
        out[i] = values[order[first[i] : first[i] + size[i]]].sum(axis=0)
    for j in range(int(size[large]) if large < len(size) else 0):
        upto = int(np.searchsorted(-size, -j))
        out[large:upto] += values[order[first[large:upto] + j]]
    total = np.empty_like(out)
    total[by] = out
    return total


_GAINS = "block int, salt int, gains binary"


def _stretches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        for ids in batch.column(column):
            ids = np.frombuffer(ids.as_py(), dtype=np.uint16)
            held.append(ids)
            n += len(ids)
            if n >= STRETCH:
                yield held
                held, n = [], 0
    if held:
        yield held


def _train_map(model, rate: float):
    """What a task's weights gained, by blocks of rows: uses, then gains times uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        net = copy.deepcopy(model.value)
        used = (np.zeros((CLASS_ROWS, 1), dtype=np.int64), np.zeros((WORD_ROWS, net.classes), dtype=np.int64))
        seen = 0
        for held in _stretches(batches, 0):
            ids, before = _contexts(held)
            rows = net.features(before)
            order = np.random.default_rng(len(ids)).permutation(len(ids))
            at = 0
            while at < len(order):
                some = order[at : at + min(STEP, FIRST + seen // 16)]
                net.step(ids[some], (rows[0][:, some], rows[1][:, some]), rate / math.sqrt(1 + seen / (16 * STEP)), used)
                at += len(some)
                seen += len(some)
        task = TaskContext.get().partitionId()
        widths = np.diff(net.start)
        sides = ((net.by_class - model.value.by_class, used[0], used[0], CLASS_BLOCK), (net.by_word - model.value.by_word, used[1], np.repeat(used[1], widths, axis=1), WORD_BLOCK))
        block = 0
        for gain, uses, wide, size in sides:
            for first in range(0, len(gain), size):
                part = slice(first, first + size)
                if uses[part].any():
                    whole = np.rint(gain[part].astype(np.float64) * wide[part] * _UNIT).astype("<i8")
                    data = uses[part].astype("<i8").tobytes() + whole.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task % 64], pa.int32()), pa.array([data], pa.binary())], names=["block", "salt", "gains"])
                block += 1

    return run


def _add_map():
    """The sum of each block's gains, read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, gains in zip(batch.column(0).to_pylist(), batch.column(2)):
                gains = np.frombuffer(gains.as_py(), dtype="<i8")
                total[block] = total[block] + gains if block in total else gains
        for block, gains in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([gains.tobytes()], pa.binary())], names=["block", "salt", "gains"])

    return run


def _improved(model: Model, sums: dict[int, bytes]) -> None:
    """Add the mean gain of every row, or of its words of one class, over all its uses."""
    widths, block = np.diff(model.start), 0
    for table, columns, size in ((model.by_class, 1, CLASS_BLOCK), (model.by_word, model.classes, WORD_BLOCK)):
        for first in range(0, len(table), size):
            if block in sums:
                got = np.frombuffer(sums[block], dtype="<i8")
                uses = got[: size * columns].reshape(size, columns)
                wide = uses if columns == 1 else np.repeat(uses, widths, axis=1)
                gain = got[size * columns :].reshape(size, table.shape[1]) / _UNIT
                table[first : first + size] += (gain / np.maximum(wide, 1)).astype(np.float32)
            block += 1


def _pair_map(words: int, anchors: int):
    """(pair, n): how often a frequent word is the last of the ``anchors`` most frequent ones
    before a word, or none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words * (anchors + 1), dtype=np.int64)
        for held in _stretches(batches, 0):
            flat, _ = _contexts(held)
            sizes = np.array([len(x) for x in held])
            start = np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.arange(len(flat))
            last = np.maximum.accumulate(np.where(flat < anchors, at, -1))
            last = np.concatenate([[-1], last[:-1]])
            near = (last >= start) & (at - last <= REACH)
            on = flat < words
            total += np.bincount((flat * (anchors + 1) + np.where(near, flat[np.maximum(last, 0)], anchors))[on], minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["pair", "n"])

    return run


def classes(pairs: np.ndarray, clusters: int = CLUSTERS) -> np.ndarray:
    """The class of each word from its row of ``pairs``: spherical k-means over positive
    pointwise information; classes of many words are cut by frequency."""
    words = len(pairs)
    if not words:
        return np.zeros(0, dtype=np.int64)
    n = pairs + 0.1
    info = np.maximum(0, np.log(n * n.sum() / (n.sum(axis=1, keepdims=True) * n.sum(axis=0, keepdims=True))))
    info /= np.maximum(np.linalg.norm(info, axis=1, keepdims=True), 1e-9)
    middle = info[np.linspace(0, words - 1, min(clusters, words)).astype(int)].copy()
    for _ in range(12):
        own = np.argmax(info @ middle.T, axis=1)
        for k in range(len(middle)):
            if (own == k).any():
                middle[k] = info[own == k].sum(axis=0)
                middle[k] /= max(np.linalg.norm(middle[k]), 1e-9)
    most = max(8, 2 * words // clusters)
    kind, found = np.zeros(words, dtype=np.int64), 0
    for k in range(len(middle)):
        mine = np.flatnonzero(own == k)
        for at in range(0, len(mine), most):
            kind[mine[at : at + most]] = found
            found += 1
    return kind


def fit(encoded: DataFrame, counts: np.ndarray, total: int, distinct: int) -> Model:
    """The model of the training rows of ``encoded``; ``counts`` are those of the top words."""
    spark = encoded.sparkSession
    own = counts[:WORDS]
    rest = total - int(own.sum()) + distinct - len(own) + 1
    rows = encoded.where("not held").select("ids", F.pmod(F.xxhash64("row"), F.lit(sum(SHARES))).alias("u"))
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK))
    ids = rows.select("ids").coalesce(parts)
    anchors = min(ANCHORS, len(own))
    pairs = np.zeros((len(own), anchors + 1))
    for pair, n in ids.mapInArrow(_pair_map(len(own), anchors), "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():  # words times anchors at most
        pairs.flat[pair] = n
    model = Model(own.astype(np.float64), float(rest), classes(pairs))
    at = 0
    for share in SHARES:
        held = spark.sparkContext.broadcast(model)
        mine = rows.where((F.col("u") >= at) & (F.col("u") < at + share)).select("ids").coalesce(parts)
        gains = mine.mapInArrow(_train_map(held, RATE if at == 0 else RATE / 2), _GAINS)
        for keys in (["block", "salt"], ["block"]):
            gains = gains.repartition(*keys).mapInArrow(_add_map(), _GAINS)
        _improved(model, {r[0]: bytes(r[2]) for r in gains.collect()})  # as large as the model
        at += share
    return model


def _score_map(model):
    """(row, own): the model's natural log probability of a text, words of the rest as a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, n = [], 0
                while at + len(texts) < batch.num_rows and n < STRETCH:
                    texts.append(np.frombuffer(batch.column(1)[at + len(texts)].as_py(), dtype=np.uint16))
                    n += len(texts[-1])
                ids, before = _contexts(texts)
                rows = net.features(before)
                owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
                score, inside = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
                for i in range(0, len(ids), STEP // 2):
                    some = slice(i, i + STEP // 2)
                    p = net.log_probabilities(ids[some], (rows[0][:, some], rows[1][:, some]))
                    score += np.bincount(owner[some], p, len(texts))
                    inside += np.bincount(owner[some], ids[some] < len(net.slot), len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(score), pa.array(inside)], names=["row", "model", "inside"])
                at += len(texts)

    return run


def _least_count(counts: DataFrame) -> int:
    """The least count of the words that every task knows: at most ``TOP`` reach it. Counts
    are told apart by their first seven bits, so the driver sees a few thousand rows."""
    level = F.expr("128 * length(bin(c)) + shiftright(c, greatest(length(bin(c)) - 7, 0))")
    least, n = 1 << 62, 0
    for _, low, words in sorted(counts.groupBy(level.alias("level")).agg(F.min("c"), F.count("*")).collect(), reverse=True):
        n += words
        if n > TOP:
            break
        least = low
    return least


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    sc = docs.sparkSession.sparkContext
    source = spread(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    counts = cut(source.mapInArrow(_count_map(), "h long, g int, c long").groupBy("h", "g").agg(F.sum("c").alias("c")))
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    least = _least_count(counts)
    top = sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r.c, r.h, r.g))  # at most TOP rows
    known = np.array([r.c for r in top], dtype=np.int64)
    marks = np.array([(r.h, r.g) for r in top], dtype=[("h", "<i8"), ("g", "<i4")]).tobytes()
    held = sc.broadcast(([marks[i : i + 12] for i in range(0, len(marks), 12)], np.log10(known + 1.0)))
    encoded = staged(source.mapInArrow(_encode_map(held), _ENCODED), "maxent")
    model = fit(encoded, known, total, distinct)
    # the model's own rows of ids beside its sums of counts
    scored = encoded.select("row", "ids").mapInArrow(_score_map(sc.broadcast(model)), "row long, model double, inside long")
    others = encoded.select("row", F.inline(F.arrays_zip("h", "g", "n")))
    rare = counts.where(F.col("c") < least)
    looked = others.join(rare, ["h", "g"]).groupBy("row").agg(F.sum("n").alias("met"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    rows = encoded.select("row", "doc_id", "held", "n_tokens", "n_top", "own", "rest").join(scored, "row").join(looked, "row", "left")
    own = known[:WORDS]
    base, tail = math.log10(total + distinct + 1), math.log10(total - int(own.sum()) + distinct - len(own) + 1)
    rest = F.col("rest") + F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_top") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("own") + rest - F.col("n_tokens") * base).alias("base_score"), (F.col("model") / math.log(10) + rest - (F.col("n_tokens") - F.col("inside")) * tail).alias("score"),
    )
