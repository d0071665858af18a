"""Incremental indexing, upserts and deletes on Parquet tables, and batch embedding."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources.storage import cut


def classify_changes(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, changed, unchanged, or removed where only ``old`` has the key."""
    both = new.select(key, F.col(digest).alias("_new")).join(old.select(key, F.col(digest).alias("_old")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def to_index(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``new`` whose digest is not already indexed."""
    return new.join(old.select(key, digest), [key, digest], "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` put in by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``table`` without the rows that ``keys`` name."""
    return table.join(keys.select(*on), list(on), "left_anti")


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in the table yet."""
    return rows.join(table.select(key), key, "left_anti")


def cached(cache: DataFrame, keys: DataFrame, now: float) -> DataFrame:
    """keys(key) with the cached value where it has not expired; cache(key, value, written_at, ttl)."""
    fresh = cache.where(F.col("written_at") + F.col("ttl") > F.lit(now))
    return keys.join(fresh.select("key", "value"), "key", "left").withColumn("hit", F.col("value").isNotNull())


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic embedding of hashed words, for use without a provider."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            row[h % dim] += 1 if h >> 32 & 1 else -1
    return out


def embed(texts: DataFrame, cache: DataFrame, provider: Callable[[list[str]], np.ndarray] = hashed_embedding, dim: int = 64, batch: int = 64, attempts: int = 4, backoff: float = 0.5, key: str = "idx", text_column: str = "text") -> DataFrame:
    """(key, embedding, source): from cache(content_hash, embedding), the provider, or a
    zero vector when its attempts fail. Each distinct text is sent once."""
    keyed = texts.withColumn("content_hash", content_hash(text_column))
    known = cache.select("content_hash", F.col("embedding").alias("_cached"))
    missing = keyed.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.first(text_column).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                vectors, source = np.zeros((len(part), dim)), "failed"
                for attempt in range(attempts):
                    try:
                        vectors, source = np.asarray(provider(part["text"].tolist())), "provider"
                        break
                    except Exception:  # a provider may fail in any way; the last failure gives zeros
                        if attempt + 1 < attempts:
                            time.sleep(backoff * 2**attempt)
                yield pd.DataFrame({"content_hash": part["content_hash"], "_made": list(vectors), "_source": source})

    made = missing.mapInPandas(run, "content_hash string, _made array<double>, _source string")
    rows = keyed.join(known, "content_hash", "left").join(made, "content_hash", "left")
    return rows.select(key, F.coalesce(F.col("_cached").cast("array<double>"), "_made").alias("embedding"), F.when(F.col("_cached").isNotNull(), "cache").otherwise(F.col("_source")).alias("source"))


def index_plan(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files(file_path, content_hash, n_units) with ``outcome`` and ``n_vectors``.

    A file whose hash is known is unchanged; one without units is empty, and its hash is
    kept all the same; any other is indexed and adds a vector for each unit.
    """
    known = hashes.select("file_path", F.col("content_hash").alias("_known"))
    outcome = F.when(F.col("content_hash") == F.col("_known"), "unchanged").when(F.col("n_units") == 0, "empty").otherwise("indexed")
    planned = files.join(known, "file_path", "left").withColumn("outcome", outcome).drop("_known")
    return planned.withColumn("n_vectors", F.when(F.col("outcome") == "indexed", F.col("n_units")).otherwise(0).cast("long"))


def index_counters(plan: DataFrame, *by: str) -> DataFrame:
    """Files indexed, files skipped and vectors added, of each ``by`` or of all."""
    indexed = F.count_if(F.col("outcome") == "indexed")
    return plan.groupBy(*by).agg(indexed.alias("files_indexed"), (F.count("*") - indexed).alias("files_skipped"), F.coalesce(F.sum("n_vectors"), F.lit(0)).alias("vectors_indexed"))


def index_repository(files: DataFrame, hashes: DataFrame, vectors: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed_units: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new (hashes, vectors, counters) after one run over files(file_path, content).

    ``chunk`` gives rows with file_path for the files it gets, ``embed_units`` the rows of
    ``vectors`` for them. Only files that changed are chunked; what was indexed of them
    goes. Files that are gone keep their rows: ``classify_changes`` tells them.
    """
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    changed = cut(to_index(hashed, hashes, "file_path", "content_hash"))
    units = cut(chunk(changed.drop("content_hash")))
    counts = units.groupBy("file_path").agg(F.count("*").alias("n_units"))
    sized = hashed.select("file_path", "content_hash").join(counts, "file_path", "left").fillna(0, ["n_units"])
    fresh = changed.select("file_path", "content_hash")
    return upsert(hashes, fresh, "file_path"), delete(vectors, fresh, "file_path").unionByName(embed_units(units)), index_counters(index_plan(sized, hashes))


# The status that each step of an index run leads to.
STATUS = {"queued": "pending", "started": "indexing", "finished": "ready", "failed": "error"}


def index_status(steps: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, status, message) of steps(key, step, message, order...): where the last known
    step of each key led; only an error keeps its message."""
    led = steps.where(F.col("step").isin(*STATUS))
    last = led.groupBy(key).agg(F.max_by(F.struct("step", "message"), F.struct(*order)).alias("l"))
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("l.step")]
    return last.select(key, status.alias("status"), F.when(F.col("l.step") == "failed", F.col("l.message")).alias("message"))


def cache_put(cache: DataFrame, rows: DataFrame, now: float, ttl: int = 3600) -> DataFrame:
    """``cache`` with rows(key, value struct) set as JSON; an agent's memory is such a table
    with keys of review and agent."""
    return upsert(cache, rows.select("key", F.to_json("value").alias("value"), F.lit(now).alias("written_at"), F.lit(ttl).alias("ttl")), "key")


def cache_drop(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return delete(cache, keys, "key")
