"""Cost-balanced packing of documents into fixed-length training sequences.

Each map task gathers shards of about ``SHARD_TOKENS`` tokens and packs a shard alone, so
the work needs no shuffle and no task holds more than one shard (or one document). In a
shard, whole sequences are first cut off long documents; what remains is taken in
descending length, each piece going to the sequence of lowest estimated cost, linear plus
quadratic in the piece lengths, that still has room. A piece is cut only if no sequence of
its shard has room for it whole; what is left of it then takes its turn by its length. A
shard opens as many sequences as its tokens fill; the rest, less than one sequence, goes to
the task's next shard. Only a task's last rest is dealt to sequences of a power of two,
which need no padding, so nothing is padded.

A null or empty text is its end id alone. Rows with the same doc_id are packed as separate
documents. Equal lengths follow the order of arrival in the task. A document longer than a
shard is a shard of its own. Other columns are not read, whatever their names.
``sequence_id`` is unique over the table, not consecutive. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_ids, spread
from .tokens import encoder

SEQUENCE_TOKENS = 4096
SHARD_TOKENS = 1 << 21
#: Piece length at which the quadratic attention cost equals the linear cost.
BALANCE_TOKENS = 2048.0

_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_PIECES = ", ".join(f"{name} long" for name in _NAMES)


def piece_cost(length: int, balance: float = BALANCE_TOKENS) -> float:
    return length + length * length / balance


def pack_lengths(lengths: list[int], capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for every piece."""
    return pack_shard(lengths, capacity, True)[0]


def pack_shard(lengths: list[int], capacity: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces as of ``pack_lengths``, and (document, start, length) of what is left over,
    less than one sequence; nothing is if this is the ``last`` shard."""
    pieces, rest, n_seq = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for i in range(whole):
            pieces.append((doc, i * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, doc, whole * capacity))
    total = sum(n for n, _, _ in rest)
    room = [capacity] * (total // capacity)
    if last:
        room += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    free = sum(room)
    used, cost = [0] * len(room), [0.0] * len(room)
    rest = [(-n, doc, start) for n, doc, start in rest]
    heapq.heapify(rest)
    # Pieces only get shorter, so a sequence that has room for one stays ``ready`` until it is
    # used. The others wait, the roomiest first; ``cheap`` has them by cost for what must be
    # cut. Entries of the last two that no longer hold are passed over.
    ready: list[tuple[float, int, int]] = []
    wait, cheap = [(-room[i], i) for i in range(len(room))], [(0.0, -room[i], i) for i in range(len(room))]
    heapq.heapify(wait)
    heapq.heapify(cheap)
    while rest and free:
        n, doc, start = heapq.heappop(rest)
        n = -n
        while wait and -wait[0][0] >= n:
            most, i = heapq.heappop(wait)
            if -most == room[i] - used[i]:
                heapq.heappush(ready, (cost[i], -room[i], i))
        if ready:
            i = heapq.heappop(ready)[2]
        else:
            while cheap[0][0] != cost[cheap[0][2]] or used[cheap[0][2]] == room[cheap[0][2]]:
                heapq.heappop(cheap)
            i = cheap[0][2]
        size = min(n, room[i] - used[i])
        pieces.append((doc, start, size, n_seq + i, used[i]))
        used[i] += size
        free -= size
        cost[i] += piece_cost(size)
        if used[i] < room[i]:
            heapq.heappush(wait, (used[i] - room[i], i))
            heapq.heappush(cheap, (cost[i], -room[i], i))
        if size < n:
            heapq.heappush(rest, (size - n, doc, start + size))
    return pieces, [(doc, start, -n) for n, doc, start in sorted(rest)]


def _pack_map(path: str, spaced: bool, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        next_id, held, tokens = TaskContext.get().partitionId() << 33, [], 0

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            """``held`` has (doc_id, tokens of the document, start, ids from there)."""
            nonlocal next_id, held, tokens
            pieces, left = pack_shard([len(x[3]) for x in held], capacity, last)
            if pieces:
                cuts = [held[d][3][s : s + n] for d, s, n, _, _ in pieces]
                columns = zip(*((held[d][0], held[d][2] + s, n, crc32_ids(x), held[d][1], next_id + q, at) for (d, s, n, q, at), x in zip(pieces, cuts)))
                arrays = [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in cuts], pa.list_(pa.int32())))
                next_id += max(p[3] for p in pieces) + 1
                yield pa.RecordBatch.from_arrays(arrays, names=[*_NAMES, "ids"][: len(arrays)])
            held = [(held[d][0], held[d][1], held[d][2] + s, held[d][3][s : s + n].copy()) for d, s, n in left]
            tokens = sum(len(x[3]) for x in held)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for key, ids in zip(batch.column(0).slice(i, 256).to_pylist(), enc.encode(batch.column(1).slice(i, 256).to_pylist())):
                    whole = np.frombuffer(ids + end, dtype=enc.dtype)
                    held.append((key, len(whole), 0, whole))
                    tokens += len(whole)
                    if tokens >= SHARD_TOKENS:
                        yield from packed(False)
        if held:
            yield from packed(True)
        enc.settle()

    return run


def pack(docs: DataFrame, tokenizer: str, *, spaced: bool = False, end_id: int = 2, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece; ``with_ids`` adds the piece's token ids as an array."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return spread(source).mapInArrow(_pack_map(tokenizer, spaced, end_id, capacity, with_ids), _PIECES + (", ids array<int>" if with_ids else ""))
