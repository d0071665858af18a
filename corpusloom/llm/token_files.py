"""Token-id output: canonical length-limited Huffman coding in independent blocks.

``write_token_files`` encodes texts, counts ids over all of them, derives one canonical
code of at most ``MAX_BITS`` bits a token, and writes three Parquet folders:

* ``code``   (token, bits): code lengths; the canonical code follows from them;
* ``blocks`` (part, block, start, doc_ids, lengths, stream, offsets): consecutive documents
  in ascending doc_id order, coded as one bit stream, with the ids before it in its part
  and the bit length of every ``STEP`` tokens, so that any stretch can be decoded alone;
* ``index``  (part, first): how many ids the parts before this one hold.

``read_token_files`` decodes them again. Documents with the same doc_id stay separate
rows, ordered by length and content; a null doc_id sorts first; a null or empty text is
its end id alone. An empty table gives empty folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_ids, scratch_path, spread, staged
from .tokens import encoder

#: Longest code word; 2**18 words leave room for every id of a 50,000-word vocabulary.
MAX_BITS = 18
#: Tokens between two bit-offset checkpoints.
STEP = 256
#: Tokens a block gathers before it is closed; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts[used], kind="stable")
    leaf = counts[used][order].astype(np.float64)
    levels, row = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaf, row])
        rank = np.argsort(merged, kind="stable")
        levels.append(np.cumsum(rank < n))
        merged = merged[rank]
        row = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, bits = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for leaves in reversed(levels):
        if not take:
            break
        own = int(leaves[take - 1])
        bits[:own] += 1
        take = 2 * (take - own)
    lengths[used[order]] = bits
    return lengths


class Codec:
    """Encoder and table-driven decoder of one canonical code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        bits = self.lengths[order].astype(np.int64)
        room = 1 << (MAX_BITS - bits)
        start = np.cumsum(room) - room
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[order] = (start >> (MAX_BITS - bits)).astype(np.uint64)
        self.table = np.zeros(1 << MAX_BITS, dtype=np.uint32)
        filled = np.repeat((order.astype(np.uint32) << 5) | bits.astype(np.uint32), room)
        self.table[: len(filled)] = filled

    def encode(self, texts: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """For each text its bit stream, most significant bit first, from a whole byte on,
        and the bits of every STEP tokens."""
        n = np.array([len(t) for t in texts], dtype=np.int64)
        ids = np.concatenate(texts) if len(texts) else np.zeros(0, dtype=np.int64)
        if not len(ids):
            return [(b"", b"")] * len(texts)
        size = self.lengths[ids].astype(np.int64)
        upto = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size)])
        last = np.cumsum(n)
        first = last - n
        bits = upto[last] - upto[first]
        room = -(-bits // 8)
        begin = np.cumsum(room) - room
        at = upto[:-1] + np.repeat(begin * 8 - upto[first], n)
        word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
        placed = self.codes[ids] << shift
        words = (int(begin[-1] + room[-1]) >> 2) + 2
        high = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=words)
        low = np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
        stream = (high + low).astype(np.uint32).astype(">u4").tobytes()
        marks = -(-n // STEP)
        k = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
        start = np.repeat(first, marks) + k * STEP
        gaps = (upto[np.minimum(start + STEP, np.repeat(last, marks))] - upto[start]).astype("<u2").tobytes()
        to = 2 * np.cumsum(marks)
        return [(stream[a : a + c], gaps[d - 2 * m : d]) for a, c, d, m in zip(begin.tolist(), room.tolist(), to.tolist(), marks.tolist())]

    def decode(self, parts: list[tuple[bytes, bytes, int]]) -> np.ndarray:
        """Ids of several streams (stream, offsets, tokens), one after another."""
        parts = [p for p in parts if p[2]]
        if not parts:
            return np.zeros(0, dtype=np.uint32)
        data = np.frombuffer(b"".join(x for p in parts for x in (p[0], b"\0" * 8)), dtype=np.uint8)
        at, counts, byte = [], [], 0
        for stream, marks, n in parts:
            bits = np.frombuffer(marks, dtype="<u2").astype(np.int64)
            at.append(np.cumsum(bits) - bits + byte * 8)
            k = len(bits)
            counts.append(np.append(np.full(k - 1, STEP), n - STEP * (k - 1)))
            byte += len(stream) + 8
        pos, left = np.concatenate(at), np.concatenate(counts)
        order = np.argsort(-left, kind="stable")
        p, size = pos[order], left[order]
        wide = data.astype(np.uint32)
        windows = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        alive = np.searchsorted(-size, -np.arange(1, STEP + 1), side="right")
        found = np.zeros((int(size[0]), len(p)), dtype=np.uint32)
        mask, spare = np.int64((1 << MAX_BITS) - 1), 32 - MAX_BITS
        for step, row in enumerate(found):
            k = int(alive[step])
            now = p[:k]
            hit = self.table[(windows[now >> 3] >> (spare - (now & 7))) & mask]
            row[:k] = hit >> 5
            now += hit & 31
        lanes = np.empty((len(p), len(found)), dtype=np.uint32)
        lanes[order] = found.T
        return lanes[np.arange(len(found)) < left[:, None]]


_STAGE = "doc_id long, n_tokens int, ids binary, tokens array<int>, counts array<long>"
_BLOCKS = "part int, block int, start long, doc_ids array<long>, lengths array<int>, stream binary, offsets binary"
_DOCS = "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long"


def _encode_map(path: str, spaced: bool, end_id: int, vocabulary: int):
    """Rows of encoded documents, and one last row with the ids a task has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced)
        seen = np.zeros(vocabulary, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("tokens", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            keys = batch.column(0)
            for i in range(0, batch.num_rows, 512):
                ids = [x + end for x in enc.encode(batch.column(1).slice(i, 512).to_pylist())]
                seen += np.bincount(np.frombuffer(b"".join(ids), dtype=enc.dtype), minlength=vocabulary)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([keys.slice(i, 512), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int32()), pa.array(ids, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([seen[used].tolist()], pa.list_(pa.int64()))], schema=schema)

    return run


def _block_map(code: bytes, width: str):
    """Sorted documents of a part, coded in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(np.frombuffer(code, dtype=np.uint8))
        part, block, held, tokens, start = TaskContext.get().partitionId(), 0, [], 0, 0

        def closed() -> pa.RecordBatch:
            [(stream, marks)] = codec.encode([np.frombuffer(b"".join(ids for _, _, ids in held), dtype=width)])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([[k for k, _, _ in held]], pa.list_(pa.int64())), pa.array([[n for _, n, _ in held]], pa.list_(pa.int32())), pa.array([stream], pa.binary()), pa.array([marks], pa.binary())], names=["part", "block", "start", "doc_ids", "lengths", "stream", "offsets"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(row)
                tokens += row[1]
                if tokens >= BLOCK_TOKENS:
                    yield closed()
                    block, start, held, tokens = block + 1, start + tokens, [], 0
        if held:
            yield closed()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, spaced: bool = True, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text of ``docs`` and write the three folders under ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    coded = staged(spread(source).mapInArrow(_encode_map(tokenizer, spaced, end_id, vocabulary), _STAGE), "tokens")

    counts = np.zeros(vocabulary, dtype=np.int64)
    for token, n in coded.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.counts")).collect():
        counts[token] = n  # one row an id of the vocabulary at most
    final = code_lengths(counts)
    spark.createDataFrame([(int(t), int(final[t])) for t in np.flatnonzero(final)], "token int, bits int").coalesce(1).write.parquet(f"{path}/code")

    rows = coded.where("n_tokens is not null").select("doc_id", "n_tokens", "ids")
    parts = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts.mapInArrow(_block_map(final.tobytes(), width), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    _index(spark, path).write.parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    """One row a part: the window sees as many rows as there are partitions."""
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(size).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))


def _read_map(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(np.frombuffer(lengths, dtype=np.uint8))
        for batch in batches:
            for part, start, keys, sizes, stream, marks in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = codec.decode([(stream, marks, sum(sizes))])
                ends = np.cumsum(sizes)
                crc = [crc32_ids(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - sizes + start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    return run


def _ids_map(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(np.frombuffer(lengths, dtype=np.uint8))
        for batch in batches:
            for part, start, keys, sizes, stream, marks in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = codec.decode([(stream, marks, sum(sizes))]).astype(np.int32)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([ids[e - n : e] for e, n in zip(ends, sizes)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _opened(spark: SparkSession, path: str) -> tuple[bytes, DataFrame]:
    code = spark.read.schema("token int, bits int").parquet(f"{path}/code").collect()  # one row an id
    lengths = np.zeros(max((t for t, _ in code), default=0) + 1, dtype=np.uint8)
    for token, bits in code:
        lengths[token] = bits
    return lengths.tobytes(), spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("part", "start", "doc_ids", "lengths", "stream", "offsets")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document in the files."""
    lengths, blocks = _opened(spark, path)
    return blocks.mapInArrow(_ids_map(lengths), "doc_id long, ids array<int>")


def read_token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    lengths, blocks = _opened(spark, path)
    index = spark.read.schema("part int, first long").parquet(f"{path}/index")
    return blocks.mapInArrow(_read_map(lengths), _DOCS).join(index, "part").select("doc_id", (F.col("first") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to shared storage and read the digest back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_digest(docs.sparkSession, path)
