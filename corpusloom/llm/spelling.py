"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is cut evenly into a first part of l // 2 and a last part. One edit
leaves one of the two parts whole: the first at its place, the last at its place or shifted
by the inserted character. So each word is indexed under both parts and its length, and
probes with the substrings at those places of words as long and of words one longer. Pairs
that meet are deduplicated and their edit is verified.

Where more than ``CROWD`` words share one part, its key takes in what the edit leaves of
the other half: for every position there, the word without that character. Words that
share such a key are near by construction and as many as the alphabet has letters, so no
crowd makes pairs that are not links. Nothing is dropped.

Words come from whole texts and are counted where they lie before they are shuffled. A null
text has no words; a null doc_id is written as an empty string; rows that repeat count each.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

#: The least length and count of a word, and how much more frequent its form must be.
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: One run in ``NOISE`` loses a character before it is counted.
NOISE = 31
#: Words under one part beyond which its key is widened.
CROWD = 64
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of one text and their counts, of any length."""
    found: Counter = Counter()
    mark = b"%d:" % doc_id if doc_id is not None else b":"
    for run, n in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
        h = zlib.crc32(mark + run.encode())
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def _count_map(min_length: int):
    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for word, n in words_of(doc_id.as_py(), text.as_py()).items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return run


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): the words of at least these lengths and counts."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    counted = spread(source).mapInArrow(_count_map(min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _part(word: Column, size: Column, side: int) -> Column:
    """The first or last part, as long as in a word of ``size``."""
    half = F.floor(size / 2).cast("int")
    return word.substr(F.lit(1), half) if side == 0 else word.substr(F.length(word) - (size - half) + 1, size - half)


def _keys(words: DataFrame, longer: int, column: str) -> DataFrame:
    """(word, key, side, longer) of both parts, cut as in words ``longer`` shorter. Keys are
    hashes: what meets by chance is sorted out with the other candidates."""
    w = F.col("word")
    size = F.length(w) - longer
    parts = [F.struct(F.xxhash64(F.lit(side), size, _part(w, size, side)).alias("key"), F.lit(side).cast("byte").alias("side")) for side in (0, 1)]
    return words.where(size >= 2).select(w.alias(column), F.inline(F.array(*parts)), F.lit(longer).cast("byte").alias("longer"))


def _left_out(word: Column, size: Column, side: Column, longer: Column) -> Column:
    """The word without each character that lies beyond the part that is shared."""
    half, n = F.floor(size / 2).cast("int"), F.length(word)
    first, last = F.when(side == 0, half + 1).otherwise(1), F.when(side == 0, n).otherwise(n - (size - half))
    return F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.struct(F.when(longer == 1, 0).otherwise(i).alias("place"), F.xxhash64(F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, n - i))).alias("rest")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): every pair of the distinct ``word`` one edit apart, the shorter one first."""
    index = _keys(words, 0, "a").drop("longer")
    probe = _keys(words, 0, "b").union(_keys(words, 1, "b"))
    crowds = cut(index.groupBy("key").count().where(F.col("count") > CROWD).select("key"))
    order = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    found = index.join(crowds, "key", "left_anti").join(probe.drop("side"), "key").where(order).select("a", "b")
    if crowds.take(1):
        dense, asked = index.join(crowds, "key", "left_semi"), probe.join(crowds, "key", "left_semi")
        of = lambda c: _left_out(F.col(c), F.length(c) - F.col("longer"), F.col("side"), F.col("longer"))
        whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64("a").alias("rest")))
        dense = dense.select("a", "key", "side", F.explode(F.array(F.lit(0).cast("byte"), F.lit(1).cast("byte"))).alias("longer"))
        dense = dense.select("a", "key", "longer", F.inline(F.when(F.col("longer") == 1, whole).otherwise(of("a"))))
        asked = asked.select("b", "key", "longer", F.inline(of("b")))
        found = found.union(dense.join(asked, ["key", "longer", "place", "rest"]).where(order).select("a", "b"))
    return found.distinct().where(F.levenshtein("a", "b", 1) == 1)


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = cut(word_counts(docs, id_column=id_column, text_column=text_column))
    pairs = cut(near_pairs(words.select("word")))
    near = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counted = near.join(words.withColumnRenamed("word", "other"), "other").groupBy("word")
    best = counted.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    known = F.coalesce(-F.col("best.m") >= FACTOR * F.col("n"), F.lit(False))
    found = cut(found.select("word", F.when(known, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, -F.col("best.m")).alias("form_n")))
    # each form is FACTOR times as frequent, so the ways are short; a step doubles what is walked
    way = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(way.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        way = further.select("word", "root")
        if not further.where("moved").take(1):
            break
    return found.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
