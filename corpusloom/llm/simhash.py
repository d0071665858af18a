"""SimHash near-duplicates: pigeonring candidate filtering and connected components.

A fingerprint has 64 bits; two link at ``MAX_BITS`` or fewer differing bits. The bits lie
on a ring of five segments. If two fingerprints differ in at most 4 bits, some segment
starts a chain in which the first l segments together differ in at most floor(4 l / 5)
bits, for every l: 0, 1, 2 and 3 bits for chains of one to four. Candidates are therefore
found by equality of a chain of two (one side as it is, the other with none or one bit of
the second segment turned), then pruned by the chains of three and four, and only then
compared in full. Equal fingerprints are merged first, so copies never form pairs. Where
many fingerprints share one chain of two, the key takes in the third segment, for which
the same principle holds; nothing is dropped.

A null or empty text, or one of white space only, has fingerprint zero and links like any
other. Rows that repeat a doc_id stay separate rows of the same component. A null doc_id
keeps its row; its component is the smallest doc_id that it reaches, null if none. Texts of
any length are read whole. An empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brief_shuffles, cut, discard, gathered, inner, scratch_path, scratch_scope, settled, small_batches, spread, staged, written
from .components import connected_components

MAX_BITS = 4
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints in one bucket beyond which its key takes in another segment.
CROWD = 1024

_OFFSETS = tuple(sum(WIDTHS[:i]) for i in range(5))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, words: int) -> int:
    """The 64 bits as a signed integer; a bit is set if it is set in over half of the
    shingles' XXH64 values (seed 42)."""
    return _bits(_hashes(text, words))


def _hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 value of every shingle."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    joined, hash64 = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1) if found else 0
    return np.fromiter((hash64(joined(found[i : i + words]), 42) for i in range(n)), dtype="<u8", count=n)


def _bits(hashes: np.ndarray) -> int:
    total = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 1 << 18):
        h = hashes[first : first + (1 << 18)]
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_map(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, print): the 64 bits as a signed long."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return spread(source).mapInArrow(_fingerprint_map(words), "doc_id long, print long")


def _segment(bits: Column, i: int) -> Column:
    return F.shiftrightunsigned(bits, _OFFSETS[i % 5]).bitwiseAND(F.lit((1 << WIDTHS[i % 5]) - 1))


def _chain_key(bits: Column, i: int) -> Column:
    """Chain start, first and second segment; the low 13 bits are for a third one."""
    return F.shiftleft(F.lit(i).cast("long"), 40).bitwiseOR(F.shiftleft(_segment(bits, i), 26)).bitwiseOR(F.shiftleft(_segment(bits, i + 1), 13))


def _of_start(values: list, start: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), start + 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(i: int, length: int) -> int:
    return _signed(sum(((1 << WIDTHS[k % 5]) - 1) << _OFFSETS[k % 5] for k in range(i, i + length)))


def _flips(most: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(13), n)]


def _linked(a: Column, b: Column, key: Column) -> Column:
    """The longer chains first, then all 64 bits."""
    start, diff = F.shiftright(key, 40).cast("int"), a.bitwiseXOR(b)
    chains = [F.bit_count(diff.bitwiseAND(_of_start([_mask(i, n) for i in range(5)], start))) <= MAX_BITS * n // 5 for n in (3, 4)]
    return chains[0] & chains[1] & (F.bit_count(diff) <= MAX_BITS)


def links(prints: DataFrame) -> DataFrame:
    """(x, y): every pair x < y of the distinct fingerprints ``print`` within MAX_BITS bits."""
    p = F.col("print")
    index = prints.select("print", F.explode(F.array(*[_chain_key(p, i) for i in range(5)])).alias("key"))
    probe = index.select("print", "key", F.explode(F.array(*[F.lit(m) for m in _flips(1)])).alias("turn"))
    probe = probe.select("print", F.col("key").bitwiseXOR(F.shiftleft(F.col("turn").cast("long"), 13)).alias("key"), (F.col("turn") != 0).cast("int").alias("used"))
    crowds = cut(index.groupBy("key").count().where(F.col("count") > CROWD).select("key"))

    def joined(index: DataFrame, probe: DataFrame) -> DataFrame:
        a, b = index.alias("a"), probe.alias("b")
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.print") < F.col("b.print")) & _linked(F.col("a.print"), F.col("b.print"), F.col("a.key"))
        return a.join(b, on).select(F.col("a.print").alias("x"), F.col("b.print").alias("y"))

    if not crowds.take(1):
        return joined(index, probe.select("print", "key")).distinct()
    calm = joined(index.join(crowds, "key", "left_anti"), probe.select("print", "key"))
    start = F.shiftright("key", 40).cast("int")
    third = F.element_at(F.array(*[_segment(p, i + 2) for i in range(5)]), start + 1)
    dense = index.join(crowds, "key", "left_semi").select("print", F.col("key").bitwiseOR(third).alias("key"))
    turned = probe.join(crowds, "key", "left_semi").select("print", F.col("key").bitwiseOR(third).alias("key"), F.explode(F.when(F.col("used") == 0, F.array(*[F.lit(m) for m in _flips(2)])).otherwise(F.array(*[F.lit(m) for m in _flips(1)]))).alias("turn"))
    return calm.union(joined(dense, turned.select("print", F.col("key").bitwiseXOR(F.col("turn").cast("long")).alias("key")))).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = cut(fingerprints(docs, words, id_column, text_column))
    classes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("rep")))
    first = classes.where("rep is not null")
    pairs = links(classes.select("print"))
    # a fingerprint whose only rows lack a doc_id still joins what it links; fingerprints are the nodes
    groups = connected_components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = first.join(groups.withColumnRenamed("node", "print"), "print").groupBy("component").agg(F.min("rep").alias("root"))
    linked = groups.join(roots, "component").select(F.col("node").alias("print"), "root")
    found = classes.join(linked, "print", "left").select("print", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(found, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --------------------------------------------------------------------- deduplication
# Exact likeness: prefixes of the shingle sets name the candidates, the sets decide.
#: Near copies share at least 4 of 5 shingles of their union; the tests are in whole numbers.
LIKENESS = (4, 5)
#: One document in ``SAMPLE`` is read for the order of shingles: those that ``COMMON`` or
#: more sampled sets hold, the ``MAX_COMMON`` most frequent of them, come last. Any order
#: gives the same links; this one keeps what many documents share out of the prefixes.
SAMPLE, COMMON, MAX_COMMON = 16, 2, 1 << 17
#: Slots of a set's parity bits. Two sets differ in at least as many shingles as slots.
PARITY = 512
#: Bits of the sketch that a set's open keys carry: its parity bits, folded.
SKETCH = 256
#: Sets that meet under one pivot beyond which they are told apart by what each changes in
#: their consensus, which about ``VOTERS`` of them make.
CROWDED, VOTERS = 64, 64
#: A set that shares less than one in so many of its shingles with those under a pivot meets
#: them key by key: sets of prose share some keys by chance, and the more of them the larger
#: the table, but hardly any two of them share several.
FEW = 50
#: Texts that go to a Python worker at a time.
BATCH = 512
#: Prefix keys that are shuffled at once, about. More of them meet in rounds, by their hash,
#: so that the disk for a shuffle does not grow with the table.
KEYS_AT_ONCE = 1 << 24


def _node(shingles: np.ndarray) -> int:
    """A set's own number: equal sets are one node."""
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), 7))


def _parity(shingles: np.ndarray) -> list[int]:
    """For each of ``PARITY`` slots, whether an odd number of the set's shingles lies there."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, dtype=np.uint64)]).view(np.int64), pa.int64()))


def _rare_first(common: np.ndarray):
    """Sorts distinct ascending shingles: common ones go last, the most frequent at the end."""
    sorter = np.argsort(common)
    known = common[sorter]

    def ordered(x: np.ndarray) -> np.ndarray:
        if not len(known):
            return x
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return x[np.argsort(np.where(known[at] == x, sorter[at] + 1, 0), kind="stable")]

    return ordered


def _set_map(words: int, common):
    """(id, t, node, print, size, keys, parity) of every row; the keys are the first shingles of its
    set, as many as a near copy shares one of. A set that a task meets again has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, seen = _rare_first(common.value), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                nodes, prints, sizes, keys, parity = [], [], [], [], []
                for text in part.column(1):
                    hashes = _hashes(text.as_py(), words)
                    x = np.unique(hashes)
                    nodes.append(_node(x))
                    prints.append(_bits(hashes))
                    sizes.append(len(x))
                    parity.append(_parity(x))
                    if not len(x) or nodes[-1] in seen:
                        keys.append(x[:0])
                        continue
                    seen.add(nodes[-1])
                    keys.append(ordered(x)[: len(x) - _least(len(x)) + 1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), _lists(keys), pa.array(parity, pa.list_(pa.int64()))], names=["id", "t", "node", "print", "size", "keys", "parity"])

    return run


#: Bits of a filter for each hash in it, and of any filter at most (32 MB). Beyond that the
#: hashes are joined to the rows instead. A filter only spares work: what passes it by chance
#: is sorted out by joins, so its size never changes a result.
HASH_BITS, MAX_BITS_HELD = 16, 1 << 28
#: Bits of one bucket of Spark's bitmaps.
_BUCKET = 1 << 15


def _narrowed(rows: DataFrame, hashes: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """The rows whose last column may be among the hashes in ``column``, or those for which
    it is surely not: a bitmap sized by the number of hashes is put together by the executors
    in buckets of 4 KB, broadcast, and looked up bucket by bucket where the rows lie."""
    last = rows.columns[-1]
    n = hashes.count()
    bits = max(_BUCKET, 1 << (HASH_BITS * n - 1).bit_length()) if n else _BUCKET
    if bits > MAX_BITS_HELD:
        return rows.join(hashes.select(F.col(column).alias(last)).distinct(), last, "left_semi" if inside else "left_anti").select(rows.columns)
    place = lambda c: F.pmod(F.col(c), F.lit(bits)) + 1  # noqa: E731  Spark's buckets begin at 1
    buckets = hashes.select(place(column).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    met = rows.withColumn("_p", place(last)).withColumn("_at", F.bitmap_bit_position("_p")).join(F.broadcast(buckets), F.bitmap_bucket_number("_p") == F.col("_k"), "left")
    on = F.expr("cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(_at % 8 as int)) <> 0")
    return met.where(F.coalesce(on, F.lit(False)) == inside).select(rows.columns)


def _member_map(words: int, common=None):
    """(node, shingles) of every row's set, from (id, text, text hash); rare shingles first
    if ``common`` ones are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = _rare_first(common.value) if common else lambda x: x
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                sets = [np.unique(_hashes(t.as_py(), words)) for t in batch.column(1).slice(i, 64)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), _lists([ordered(x) for x in sets])], names=["node", "shingles"])

    return run


def _least(n: int) -> int:
    """Shingles that a set of n shares with any near copy, at least."""
    return -(-LIKENESS[0] * n // LIKENESS[1])


def _alike(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b shingles with ``shared`` common ones are near copies."""
    return sum(LIKENESS) * shared >= LIKENESS[0] * (a + b)


def _sizes_fit() -> Column:
    """Whether sets of size_a and size_b shingles can be near copies at all."""
    return (F.col("size_a") * LIKENESS[1] >= F.col("size_b") * LIKENESS[0]) & (F.col("size_b") * LIKENESS[1] >= F.col("size_a") * LIKENESS[0])


def _may_share(shared: Column) -> Column:
    """Whether sets of size_a and size_b shingles can be near copies if at most ``shared`` keys
    of their prefixes are common. Up to the earlier end of both prefixes they share no more
    than that, beyond it no more than that set has left."""
    left = lambda n: F.ceil(LIKENESS[0] * F.col(n) / LIKENESS[1]) - 1
    return _alike(shared + F.greatest(left("size_a"), left("size_b")), F.col("size_a"), F.col("size_b"))


def _early_enough() -> Column:
    """Whether the first key that a set shares with any, ``first`` keys from its start, comes
    early enough for near copies of size_a and size_b shingles: what is before it is missed
    in the other set, and the sets share 4 of 9 shingles of their sizes' sum."""
    misses = lambda a, b: sum(LIKENESS) * F.col(f"first_{a}") <= LIKENESS[1] * F.col(f"size_{a}") - LIKENESS[0] * F.col(f"size_{b}")
    return misses("a", "b") & misses("b", "a")


def _promising(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, size_a, b, size_b, n) that may be near copies; the n of a pair's
    rows add up to the prefix keys that it shares at most."""
    counted = pairs.where(_sizes_fit()).groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return counted.where(_may_share(F.col("n"))).select("a", "b")


def _sketch(parity: str) -> list[Column]:
    """The parity bits of ``SKETCH`` slots, in longs named s0, s1, ...; slots that fall
    together add up, so that sets still differ in at least as many shingles as slots."""
    n = SKETCH // 64
    return [reduce(Column.bitwiseXOR, [F.col(parity)[k] for k in range(i, PARITY // 64, n)]).alias(f"s{i}") for i in range(n)]


def _differ(x: str, y: str) -> Column:
    """Slots in which the sketches of two columns' names, which hold {}, differ."""
    return sum((F.bit_count(F.col(x.format(i)).bitwiseXOR(F.col(y.format(i)))) for i in range(SKETCH // 64)), F.lit(0))


def _near_enough(differ: Column, a: str, b: str) -> Column:
    """Whether sets that differ in so many shingles at least can be near copies: sets of
    likeness r differ in (1 - r) / (1 + r) of their sizes' sum."""
    return differ * sum(LIKENESS) <= (LIKENESS[1] - LIKENESS[0]) * (F.col(a) + F.col(b))


def _sets(wanted: DataFrame, rows: DataFrame, source: DataFrame, member_map) -> DataFrame:
    """(node, shingles) of the distinct ``wanted`` nodes, made where their texts lie."""
    texts = rows.join(wanted, "node", "left_semi")
    sets = _narrowed(source, texts, "t").mapInArrow(member_map, "node long, shingles array<long>")
    return staged(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "near-members")


def _verified(pairs: DataFrame, rows: DataFrame, source: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are near copies. Pairs whose parity bits tell them
    apart go first; of the rest, sets are made where their texts lie, so no text is shuffled."""
    for k in "ab":
        pairs = pairs.join(rows.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("parity").alias(f"parity_{k}")), k)
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY // 64)), F.lit(0))
    pairs = staged(pairs.where(_near_enough(apart, "size_a", "size_b")).select("a", "b"), "near-pairs")
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), rows, source, _member_map(words))
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(a, "a").join(b, "b").where(_alike(shared, F.size("set_a"), F.size("set_b"))).select("a", "b")


def _common(source: DataFrame, words: int) -> np.ndarray:
    """Common shingles, the least frequent first; at most MAX_COMMON."""
    some = source.where(F.pmod("_t", F.lit(SAMPLE)) == 0).mapInArrow(_member_map(words), "node long, shingles array<long>").dropDuplicates(["node"])
    top = some.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MAX_COMMON)
    return np.array([r[0] for r in top.collect()][::-1], dtype=np.int64).view(np.uint64)


def _shared(index: DataFrame, value: str) -> DataFrame:
    """The rows of ``index`` whose key is that of more than one ``value``, with the least of
    them as lo. Aggregation and join share one shuffle; the join holds a row a key and
    streams the others, however many one key has."""
    dealt = index.repartition("key")
    # both sides name all columns, so that their shuffle is the same
    last = F.max(F.struct(value, *(c for c in index.columns if c not in ("key", value))))[value]
    ends = dealt.groupBy("key").agg(F.min(value).alias("lo"), last.alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return dealt.join(ends.drop("hi"), "key")


def _met_keys(prints: DataFrame) -> DataFrame:
    """(key, node, size, at, lo) of all prefix keys that several sets hold, with their places in
    the set and the smallest of their nodes as lo; at most about ``KEYS_AT_ONCE`` keys are shuffled at once."""
    rounds = -(-(prints.agg(F.sum(F.size("keys"))).first()[0] or 1) // KEYS_AT_ONCE)

    def met(i: int) -> DataFrame:
        keys = prints.select("node", "size", F.posexplode("keys").alias("at", "key")).where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == i)
        keys = keys.select("key", "node", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("size_at"))
        found = _shared(keys, "node").distinct()
        return found.select("key", "node", F.shiftright("size_at", 32).cast("int").alias("size"), F.col("size_at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"), "lo")

    return gathered(prints.sparkSession, "near-keys", map(met, range(rounds)))


def _by_consensus(crowd: DataFrame, make_sets: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Of the sets (pivot, m, node, size, c) that meet under a pivot, m in all: (a, b) near
    copies that join some components c, and (a, b) that may be near copies beside those.

    The consensus of a pivot is what over half of about ``VOTERS`` sets hold. A set's changes
    are the shingles that it adds to the consensus or lacks. Sets of n and m shingles are near
    copies if they differ in at most (n + m) / 9, and they differ in just the changes that they
    do not share. So with slack = n - 9 * changes, sets whose slacks add up to 0 or more are
    near copies: one edge to the set of the most slack joins all of these. Others must share
    -(slack + slack) / 18 changes, and so one of the first of each, in a common order. Members
    of a large family share what is in the consensus, but hardly any changes. Any consensus
    gives the same links.
    """
    total, gap = sum(LIKENESS), LIKENESS[1] - LIKENESS[0]

    def changes() -> DataFrame:
        sets = make_sets()
        voters = crowd.where(F.pmod(F.xxhash64("node", "pivot"), F.ceil(F.col("m") / VOTERS)) == 0).select("pivot", "node")
        heads = voters.groupBy("pivot").agg(F.count("*").alias("heads"))
        votes = voters.join(sets, "node").select("pivot", F.explode("shingles").alias("s")).groupBy("pivot", "s").agg(F.count("*").alias("n"))
        held = votes.join(heads, "pivot").where("2 * n > heads")
        # what fewest lack comes first
        agreed = held.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "s")))["s"].alias("agreed"))
        met = crowd.join(sets, "node").join(agreed, "pivot", "left").withColumn("agreed", F.coalesce("agreed", F.array().cast("array<long>")))
        met = met.select("pivot", "node", "size", "c", F.concat(F.array_except("shingles", "agreed"), F.array_except("agreed", "shingles")).alias("changes"))
        return met.withColumn("slack", gap * F.col("size") - total * F.size("changes"))

    met = settled(crowd.sparkSession, "near-changes", changes)
    best = met.groupBy("pivot").agg(F.max(F.struct("slack", "node", "c")).alias("best"))
    met = met.join(best, "pivot").withColumn("near", F.expr("slack + best.slack >= 0"))
    joined = met.where("near and node <> best.node").select(F.col("node").alias("a"), F.col("best.node").alias("b"))
    # a set that is joined to the best looks for sets that are not, any other for all
    most = F.when(F.col("near"), -F.col("best.slack") - 1).otherwise(F.col("best.slack"))
    share = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + most) / (2 * total)))
    n = F.size("changes")
    firsts = F.slice("changes", F.lit(1), F.greatest(F.lit(0), n - share + 1).cast("int"))
    c = F.when(F.col("near"), F.col("best.c")).otherwise(F.col("c"))
    index = met.select("pivot", "node", "size", "slack", c.alias("c"), n.alias("left"), F.posexplode(firsts).alias("at", "change"))
    index = index.withColumn("left", F.col("left") - F.col("at")).drop("at")
    x, y = (index.select("pivot", "change", *(F.col(f).alias(f"{f}_{k}") for f in ("size", "slack", "c", "left")), F.col("node").alias(k)) for k in "ab")
    enough = 2 * total * F.least("left_a", "left_b") >= -(F.col("slack_a") + F.col("slack_b"))
    return joined, x.join(y, ["pivot", "change"]).where(F.expr("a < b and c_a <> c_b") & _sizes_fit() & enough).select("a", "b").distinct()


def likeness_links(source: DataFrame, prints: DataFrame, rows: DataFrame, known: DataFrame, words: int, common, spent: Callable[[], None]) -> DataFrame:
    """(a, b): edges that, with ``known`` ones, join all nodes of Jaccard likeness 0.8.

    ``source`` has (_id, text, _t), ``prints`` the prefixes, ``rows`` a row (id, t) of every
    node. Near copies share a key of their prefixes. First every set is compared with the
    smallest node of each of its keys, the key's pivot, which joins groups of copies without
    making all their pairs. For keys that then still hold several components, sets of unlike
    components meet once under each pivot that they share, not once a key: all of them if at
    most ``CROWDED`` meet there, else those that share a change of their consensus. A set of
    ``FEW`` keys under a pivot meets those that share one of these keys instead. No key is
    dropped and no pair that may reach the likeness is left out. Tables on the way are deleted
    as soon as the next step has what it needs of them; ``spent`` does so for ``prints``.
    """
    spark, parts = source.sparkSession, []

    def meet() -> DataFrame:
        held = _met_keys(prints)
        spent()
        under = staged(held.groupBy("lo", "node", "size").agg(F.count("*").alias("n")), "near-under")
        counted = under.join(under.groupBy("node").agg(F.sum("n").alias("keys")), "node")
        side = lambda k: counted.select("lo", F.col("node").alias(k), *(F.col(f).alias(f"{f}_{k}") for f in ("size", "keys")))
        stars = side("a").where("a = lo").join(side("b").where("b <> lo"), "lo").where(_sizes_fit() & _may_share(F.least("keys_a", "keys_b")))
        parts.append(cut(settled(spark, "near-first", lambda: _verified(stars.select("a", "b"), rows, source, words))))
        groups = connected_components(known.union(parts[0]))
        told = held.withColumnRenamed("lo", "pivot").join(groups, "node", "left").select("key", "node", "size", "at", "pivot", F.coalesce("component", "node").alias("c"))
        # sets are told from their pivots by now, so keys of two sets are done
        return _shared(told, "c").where("n > 2").drop("lo", "n")

    told = settled(spark, "near-told", meet)  # the keys are the largest table and go once met
    first = parts[0]
    met = staged(told.groupBy("pivot", "node", "size", "c").agg(F.count("*").alias("n"), F.min("at").alias("at")), "near-met")
    keys = staged(met.groupBy("node").agg(F.sum("n").alias("keys"), F.min("at").alias("first")), "near-counts")
    few, many = F.col("n") * FEW < F.col("size"), F.col("n") * FEW >= F.col("size")
    pivots = staged(met.where(many).groupBy("pivot").agg(F.count("*").alias("m")), "near-pivots")
    longs = [f"s{i}" for i in range(SKETCH // 64)]
    calm = met.where(many).join(pivots.where(F.col("m") <= CROWDED).select("pivot"), "pivot").where("node <> pivot")
    calm = calm.join(keys, "node").join(rows.select("node", *_sketch("parity")), "node")
    ends = ("size", "c", "keys", "first")
    x, y = (calm.select("pivot", F.col("node").alias(k), *(F.col(f).alias(f"{f}_{k}") for f in (*ends, "n", *longs))) for k in "ab")
    alike = F.expr("c_a <> c_b") & _sizes_fit() & _early_enough() & _may_share(F.least("keys_a", "keys_b"))
    pairs = x.join(y, "pivot").where(F.expr("a < b") & alike & _near_enough(_differ("s{}_a", "s{}_b"), "size_a", "size_b"))
    some = met.where("node <> pivot").select("pivot", "node", few.alias("few")).join(keys, "node")
    some = told.drop("at").join(some, ["pivot", "node"])
    x, y = (some.select("key", "few", F.col("node").alias(k), *(F.col(f).alias(f"{f}_{k}") for f in ends)) for k in "ab")
    y = y.withColumnRenamed("few", "few_b")
    seldom = x.where("few").join(y, "key").where(F.expr("a <> b and (a < b or not few_b)") & alike)
    seldom = seldom.select(F.least("a", "b").alias("a"), F.expr("if(a < b, size_a, size_b)").alias("size_a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, size_b, size_a)").alias("size_b"), F.lit(1).cast("long").alias("n"))
    rest = _promising(pairs.select("a", "size_a", "b", "size_b", F.least("n_a", "n_b").alias("n")).union(seldom))
    crowd = staged(met.where(many).drop("n", "at").join(pivots.where(F.col("m") > CROWDED), "pivot"), "near-crowd")
    if crowd.take(1):

        def changed() -> DataFrame:
            joined, near = _by_consensus(crowd, lambda: _sets(crowd.select("node").distinct(), rows, source, _member_map(words, common)))
            return joined.withColumn("sure", F.lit(True)).union(near.withColumn("sure", F.lit(False)))

        edges = settled(spark, "near-crowds", changed)
        first, rest = first.union(edges.where("sure").select("a", "b")), rest.union(edges.where("not sure").select("a", "b")).distinct()
    return first.union(_verified(rest, rows, source, words))


def deduplicate(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row of the smallest id of every group of near copies, and one of repeated rows.

    Two rows are near copies if their sets of shingles have a Jaccard likeness of 0.8 or
    more, found exactly at any table size, or their SimHashes differ in at most ``MAX_BITS``
    bits. A row is its id and its text: rows of one id with unlike texts stay apart; of rows
    equal in both, one stays, whichever it is. Rows without an id follow all rows with one.
    Sets are told apart by 64-bit hashes. Input columns may have any names and are returned
    as they are.
    """
    spark = docs.sparkSession
    with small_batches(spark, BATCH), brief_shuffles(spark):  # all Python work is done within, the result is a plan of joins
        return _deduplicated(docs, words, id_column, text_column)


def _deduplicated(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    outer, column = inner(docs)
    text = F.col(column[text_column]).cast("string")
    marked = outer.withColumn("_id", F.coalesce(F.col(column[id_column]).cast("long"), F.lit((1 << 63) - 1))).withColumn("_t", F.xxhash64(text))
    with scratch_scope(spark):
        kept, moved = _kept(spread(marked.select("_id", text.alias("text"), "_t")), words)
    alone, met = (_narrowed(marked, moved, "t", inside) for inside in (False, True))
    met = met.join(kept, ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"])
    return alone.select(*outer.columns).union(met.select(*outer.columns)).toDF(*docs.columns)


def _kept(source: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows (_id, _t) that stay, and the texts t of rows that fall or repeat."""
    spark = source.sparkSession
    common = spark.sparkContext.broadcast(_common(source, words))  # at most 1 MB
    path = scratch_path(spark, "near-sets")
    prints = written(source.mapInArrow(_set_map(words, common), "id long, t long, node long, print long, size int, keys array<long>, parity array<long>"), path)
    marks = staged(prints.select("id", "t", "node", "print"), "near-marks")
    rows = staged(prints.groupBy("node").agg(F.min(F.struct("id", "t", "size", "parity")).alias("r")).select("node", "r.*"), "near-rows")

    def alike() -> DataFrame:
        firsts = staged(marks.groupBy("print").agg(F.min("node").alias("first")), "near-prints")
        same = marks.join(firsts, "print").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
        x, y = firsts.select(F.col("print").alias("x"), F.col("first").alias("a")), firsts.select(F.col("print").alias("y"), F.col("first").alias("b"))
        return same.union(links(firsts.select("print")).join(x, "x").join(y, "y").select("a", "b"))

    known = settled(spark, "near-known", alike)
    near = settled(spark, "near-links", lambda: likeness_links(source, prints, rows, known, words, common, lambda: discard(spark, path)))
    groups = connected_components(known.union(near))
    named = rows.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min(F.struct("id", "t")).alias("r"))
    kept = cut(named.select(F.col("r.id").alias("_id"), F.col("r.t").alias("_t")))
    # rows that fall, and rows that repeat: only they meet in a shuffle, and what passes by chance
    fallen = rows.select("id", "t").join(kept.select(F.col("_id").alias("id"), F.col("_t").alias("t")), ["id", "t"], "left_anti")
    # a text under two ids, or a set with two texts, has one row in ``rows``: the others fall too
    others = marks.select("id", "t").join(rows.select("id", "t"), ["id", "t"], "left_anti")
    repeated = marks.groupBy("id", "t").count().where("count > 1").select("id", "t")
    return kept, cut(fallen.union(others).union(repeated).select("t").distinct())
