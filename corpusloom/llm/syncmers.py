"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest of its inner s-mers lies at
its first or last place. That depends on the k-mer alone, so the same passage selects the
same k-mers in any context. The selected k-mers fill ``BINS`` bins of a one-permutation
minhash; empty bins borrow from filled ones by a fixed sequence of bins. One byte of each
bin's minimum makes the fingerprint, and the share of equal bytes, corrected for chance,
estimates the Jaccard likeness of two texts' syncmer sets.

A text shorter than ``K`` code points, or one with no syncmer, is one k-mer by itself; a
null text counts as empty; the empty text's fingerprint is all zero and its likeness is 1
to another empty text and 0 to any other. Rows with equal doc_id follow each other by the
order of their texts' lengths and contents; rows without doc_id come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, S = 16, 8
BINS = 128

_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every window of ``width`` code points, by doubling."""
    h, size, power = codes, 1, _B
    parts: list[tuple[np.ndarray, int, np.uint64]] = []
    while True:
        if width & size:
            parts.append((h, size, power))
        if size * 2 > width:
            break
        h = h[: len(h) - size] * power + h[size:]
        size, power = size * 2, power * power
    n, at, out = len(codes) - width + 1, 0, None
    for part, size, power in reversed(parts):
        piece = part[at : at + n]
        out = piece if out is None else out * power + piece
        at += size
    return out


def syncmer_hashes(text: str, k: int = K, s: int = S) -> np.ndarray:
    """The hash of every closed syncmer of ``text``, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(codes) < k:
            return _mix(_rolling(codes, len(codes)))[:1]
        inner = _mix(_rolling(codes, s))
        n, span = len(codes) - k + 1, k - s + 1
        low, size = inner, 1
        while size * 2 <= span:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        least = np.minimum(low[:n], low[span - size : span - size + n])
        at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
        if not len(at):
            return _mix(_rolling(codes, len(codes)))[:1]
        # a k-mer's hash combines the hashes of its s-mers that tile it
        out = inner[at]
        for step in [*range(s, k - s, s), k - s]:
            out = out * _B + inner[at + step]
        return _mix(out)


def _borrowing(rounds: int = 64) -> np.ndarray:
    """For each bin, the order of bins from which it borrows when empty."""
    with np.errstate(over="ignore"):
        x = np.arange(BINS * rounds, dtype=np.uint64).reshape(BINS, rounds) * _B + _M1
        return (_mix(x) % np.uint64(BINS)).astype(np.int64)


_FROM = _borrowing()


def sketch(hashes: np.ndarray) -> bytes:
    """One byte a bin; the empty set is all zero."""
    if not len(hashes):
        return bytes(BINS)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(BINS, full)
    where = (hashes % np.uint64(BINS)).astype(np.int64)
    value = hashes >> np.uint64(8)
    order = np.lexsort((value, where))
    bins, first = np.unique(where[order], return_index=True)
    least[bins] = value[order][first]
    empty = np.flatnonzero(least == full)
    if len(empty):
        filled = least != full
        source = _FROM[empty]
        hit = filled[source]
        pick = source[np.arange(len(empty)), hit.argmax(axis=1)]
        lost = ~hit.any(axis=1)
        pick[lost] = np.flatnonzero(filled)[0]
        with np.errstate(over="ignore"):
            least[empty] = _mix(least[pick] + empty.astype(np.uint64) * _B) >> np.uint64(8)
    return (least & np.uint64(0xFF)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes, empty_a: bool, empty_b: bool) -> float:
    if empty_a or empty_b:
        return float(empty_a and empty_b)
    same = sum(x == y for x, y in zip(a, b)) / BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def _fingerprint_map():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sketch(syncmer_hashes(t)).hex() for t in texts])], names=["doc_id", "n_chars", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row, in one pass without a shuffle."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_fingerprint_map(), "doc_id long, n_chars long, fingerprint string")


_ROWS = "part int, last boolean, doc_id long, text string, n_chars long, own binary, edited_sha256 string, edited binary, near_edited double, near_next double, head string"


def _compared(text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    q = len(text) // 4
    edited = text[: len(text) - q] + following[:q]
    print_ = own if edited == text else sketch(syncmer_hashes(edited))
    return hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, likeness(own, print_, not text, not edited), likeness(own, next_own, not text, not following)


_SCHEMA = pa.schema([("part", pa.int32()), ("last", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("own", pa.binary()), ("edited_sha256", pa.string()), ("edited", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("head", pa.string())])


def _neighbour_map():
    """Each row of a sorted part against the next; a part's last row stays open and keeps
    its text, and the same row carries the text of the part's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head, out = TaskContext.get().partitionId(), None, None, []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for key, text in zip(batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256).to_pylist()):
                    own = sketch(syncmer_hashes(text))
                    if held is None:
                        head = text
                    else:
                        out.append((part, False, held[0], None, len(held[1]), held[2], *_compared(held[1], held[2], text, own), None))
                    held = (key, text, own)
                if out:
                    yield flushed()
                    out = []
        if held is not None:
            out.append((part, True, held[0], held[1], len(held[1]), held[2], None, None, None, None, head))
            yield flushed()

    return run


def _closing_map():
    """The open rows, one a part, against the first document of the next part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, own, following in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sha, edited, a, b = _compared(text, own, following, sketch(syncmer_hashes(following)))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([own], pa.binary()), pa.array([sha]), pa.array([edited], pa.binary()), pa.array([a]), pa.array([b])], names=["doc_id", "n_chars", "own", "edited_sha256", "edited", "near_edited", "near_next"])

    return run


def neighbour_likeness(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is replaced by
    the start of the next document's, with their likenesses.

    One range shuffle brings neighbours together. Only a part's last row needs another
    part: as many rows as there are parts are joined to the next part's first text.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = cut(source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), "text").mapInArrow(_neighbour_map(), _ROWS))
    columns = ["doc_id", "n_chars", "own", "edited_sha256", "edited", "near_edited", "near_next"]
    parts = Window.orderBy("part")
    ends = rows.where("last").select("part", "doc_id", "text", "own", "head")
    following = F.coalesce(F.lead("head").over(parts), F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    closed = ends.select("doc_id", "text", "own", following.alias("following"), "part").select("doc_id", "text", "own", "following").mapInArrow(_closing_map(), "doc_id long, n_chars long, own binary, edited_sha256 string, edited binary, near_edited double, near_next double")
    return rows.where("not last").select(*columns).union(closed).select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next")
