"""Token counts by unigram segmentation over a trie of distinct pre-tokens.

A pre-token is a word between white space with the mark of a preceding space. The best
segmentation of a word into vocabulary pieces maximises the sum of their log
probabilities; the forward recursion over the word's prefixes finds it. Prefixes shared by
several words are computed once: the distinct new words of a batch form a trie, whose
nodes are taken level by level, each with its best score and token count, and each word
reads its count at its terminal node.

Probabilities follow Zipf's law over the order of a public vocabulary, whose pieces are
listed by merge rank; nothing is trained. A character that is no piece is spelled in bytes,
each a token, at a penalty. A null or empty text, or one of white space only, has 0 tokens.
Rows that repeat are counted alike, ties go to the shorter last piece, words of any length
are segmented whole, and an empty table gives no rows. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

SPACE = "▁"
#: Log probability that a spelled character loses against the rarest piece.
PENALTY = 10.0
#: Words remembered by one Python worker before the memory is emptied.
MEMO_WORDS = 700_000
#: Longer words are segmented one by one, in memory proportional to their length.
TRIE_CHARS = 48

_B = np.uint64(0x9E3779B97F4A7C15)


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log probability) of a sentencepiece file's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranks = np.arange(1, len(pieces) + 1, dtype=np.float64)
    return list(zip(pieces, (-np.log(ranks) - np.log((1 / ranks).sum())).tolist()))


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points; column d covers the first d."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for d in range(codes.shape[1]):
            out[:, d + 1] = out[:, d] * _B + codes[:, d] + np.uint64(1)
    return out


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.score = dict(vocabulary)
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - PENALTY
        pieces = list(self.score)
        width = self.longest
        codes = np.array([[ord(c) for c in p] + [0] * (width - len(p)) for p in pieces], dtype=np.uint64).reshape(len(pieces), width)
        n = np.array([len(p) for p in pieces], dtype=np.int64)
        keys = _hash(codes)[np.arange(len(pieces)), n]
        order = np.argsort(keys)
        self.codes, self.sizes = codes[order], n[order]
        self.keys, self.values = keys[order], np.array([self.score[p] for p in pieces])[order]
        self.lengths = set(n.tolist())
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(width, _B, dtype=np.uint64)]))
        self.memo: dict[str, int] = {}

    def one(self, word: str) -> int:
        """Tokens of a single word by the plain recursion."""
        best, count = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
        for d in range(1, len(word) + 1):
            for k in range(1, min(d, self.longest) + 1):
                s = self.score.get(word[d - k : d])
                n = 1
                if s is None:
                    if k > 1:
                        continue
                    s, n = self.unknown, len(word[d - 1].encode("utf-8", "replace"))
                if best[d - k] + s > best[d]:
                    best[d], count[d] = best[d - k] + s, count[d - k] + n
        return count[-1]

    def trie(self, words: list[str]) -> list[int]:
        """Tokens of many words, shared prefixes computed once."""
        words = sorted(words)
        n = np.array([len(w) for w in words], dtype=np.int64)
        width = int(n.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.zeros((len(words), width), dtype=np.uint64)
        codes[np.arange(width) < n[:, None]] = flat
        prefix = _hash(codes)
        node = np.zeros((len(words), width + 1), dtype=np.int64)
        fresh = np.zeros(len(words), dtype=bool)
        fresh[0] = True
        best, count = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
        out = np.zeros(len(words), dtype=np.int64)
        for d in range(1, width + 1):
            # sorted words share a prefix only with their neighbours
            fresh[1:] |= codes[1:, d - 1] != codes[:-1, d - 1]
            deep = n >= d
            new = fresh & deep
            node[:, d] = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            char = codes[at, d - 1]
            spelled = 1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF)
            up = node[at, d - 1]
            top, tokens = best[d - 1][up] + self.unknown, count[d - 1][up] + spelled
            with np.errstate(over="ignore"):
                for k in range(1, min(d, self.longest) + 1):
                    if k not in self.lengths:
                        continue
                    key = prefix[at, d] - prefix[at, d - k] * self.power[k]
                    i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    on = np.flatnonzero((self.keys[i] == key) & (self.sizes[i] == k))
                    # the hash has found the piece, its characters decide
                    on = on[(codes[at[on], d - k : d] == self.codes[i[on], :k]).all(axis=1)]
                    up = node[at[on], d - k]
                    total = best[d - k][up] + self.values[i[on]]
                    # a piece of one character is always taken before its spelling
                    win = (total > top[on]) | (k == 1)
                    top[on[win]], tokens[on[win]] = total[win], count[d - k][up[win]] + 1
            best.append(top)
            count.append(tokens)
            done = np.flatnonzero(n == d)
            out[done] = tokens[node[done, d]]
        self.memo.update(zip(words, out.tolist()))
        return out.tolist()

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(words, tokens) of whole texts."""
        split = [[SPACE + w for w in (t or "").split()] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in set().union(*split) if w not in self.memo]
        if short := [w for w in new if len(w) <= TRIE_CHARS]:
            self.trie(short)
        self.memo.update((w, self.one(w)) for w in new if len(w) > TRIE_CHARS)
        get = self.memo.__getitem__
        return [(len(ws), sum(map(get, ws))) for ws in split]


@lru_cache(maxsize=2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(zipf_vocabulary(path))


def _count_map(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                found = counter.counts(batch.column(1).slice(i, 1024).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1024), pa.array([w for w, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every row, in one pass without a shuffle.

    vocabulary: the path of a sentencepiece file on every machine.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return spread(source).mapInArrow(_count_map(vocabulary), "doc_id long, n_words long, n_tokens long")
