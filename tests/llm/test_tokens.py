"""Tokenizers, token files, packing and counts against the libraries themselves."""

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from corpusloom.llm import packing, token_counts, token_files, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(3, "Hello, world! It's a test.\n\nTwo  spaces"), (1, None), (2, ""), (7, "çà et là, l'été 2024!!"), (7, "çà et là, l'été 2024!!"), (9, "the " * 9000 + "end"), (None, "no id"), (4, "Привет мир 中文 😀"), (5, " lead and trail ")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, ids string")


@lru_cache
def library(path):
    return Tokenizer.from_file(path)


def ids_of(path, text):
    t = library(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_encoder_equals_the_library_on_odd_texts(path, spaced):
    rng = random.Random(3)
    parts = ["a", "B", "é", "ß", " ", " ", "\n", ".", ",", "'", "'s", "9", "²", "_", "!!", "Ж", "中", "́", "\xa0", "\t", "<|endoftext|>", "  ", "İ", "’", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [b for _, b in ROWS]
    enc = tokens.WordEncoder(path, spaced)
    for text, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == ids_of(path, text)[:-1], text


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_words_whose_hashes_collide_keep_their_ids(path, spaced):
    """A Thue-Morse word and its complement collide in any polynomial hash modulo 2**64."""
    words = []
    for size in (1024, 2048):
        bits = [i.bit_count() & 1 for i in range(size)]
        words += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    texts = [" ".join(words), *words, "see " + words[1] + ", " + words[0], "<|endoftext|>" + words[2], "a <|endoftext|> b", "a <|ENDOFTEXT|> b"]
    enc = tokens.WordEncoder(path, spaced)
    for batch in (texts, texts[::-1], [words[1]], [words[0]]):
        for text, got in zip(batch, enc.encode(batch)):
            assert np.frombuffer(got, enc.dtype).tolist() == ids_of(path, text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=700), max_size=8))
def test_huffman_round_trip(lists):
    arrays = [np.array(x, dtype=np.int64) for x in lists]
    counts = np.bincount(np.concatenate([*arrays, [0]]).astype(int), minlength=61)
    codec = token_files.Codec(token_files.code_lengths(counts))
    coded = codec.encode(arrays)
    back = codec.decode([(s, m, len(a)) for (s, m), a in zip(coded, arrays)])
    assert back.tolist() == [i for a in lists for i in a]
    for (s, m), a in zip(coded, arrays):  # each stream alone
        assert codec.decode([(s, m, len(a))]).tolist() == a.tolist()


def test_code_lengths_are_limited_and_optimal_without_limit():
    import heapq

    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, 300)
    lengths = token_files.code_lengths(counts)
    heap = list(map(int, counts))
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert int((counts * lengths).sum()) == cost
    steep = np.array([int(1.7**i) + 1 for i in range(60)])
    limited = token_files.code_lengths(steep)
    assert limited.max() <= token_files.MAX_BITS and (0.5 ** limited.astype(float)).sum() <= 1 + 1e-12


def test_token_files(spark):
    rows = token_files.round_trip(docs(spark), BYTE).collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for got, (key, text) in zip(sorted(rows, key=lambda r: r.start), want):
        ids = ids_of(BYTE, text)
        assert tuple(got) == (key, start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(ROWS)
    assert token_files.round_trip(docs(spark, []), BYTE).count() == 0


def test_token_files_give_ids_back(spark, tmp_path):
    token_files.write_token_files(docs(spark), str(tmp_path / "t"), BYTE)
    got = {r.doc_id: list(r.ids) for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}
    assert all(got[k] == ids_of(BYTE, b) for k, b in ROWS)


def check_packing(rows, want, capacity=packing.SEQUENCE_TOKENS):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    assert sum(r.length for r in rows) == sum(map(len, want))
    return by_doc


def test_packing(spark):
    rows = packing.pack(docs(spark), WORD, with_ids=True).collect()
    want = {k: ids_of(WORD, b) for k, b in ROWS}
    by_doc = check_packing(rows, [ids_of(WORD, b) for _, b in ROWS])
    for (key, n), pieces in by_doc.items():
        assert n == len(want[key])
        covered = sorted(i for r in pieces for i in range(r.start, r.start + r.length))
        assert covered == sorted(list(range(n)) * [k for k, _ in ROWS].count(key))
        for r in pieces:
            assert list(r.ids) == want[key][r.start : r.start + r.length] and r.ids_crc32 == crc(list(r.ids))
    assert packing.pack(docs(spark, []), WORD).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
def test_pack_lengths_cover_everything_once(lengths):
    pieces = packing.pack_lengths(lengths, 64)
    for doc, n in enumerate(lengths):
        assert sorted(i for d, s, k, _, _ in pieces if d == doc for i in range(s, s + k)) == list(range(n))
    fill = {}
    for _, _, k, q, at in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert fill.get(q, 0) == at
        fill[q] = at + k
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values())


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randint(1, 2000) for _ in range(600)]
    cost = {}
    for _, _, k, q, _ in packing.pack_lengths(lengths):
        cost[q] = cost.get(q, 0) + packing.piece_cost(k)
    first_fit = {}
    q = at = 0
    for n in lengths:
        if at + n > 4096:
            q, at = q + 1, 0
        first_fit[q] = first_fit.get(q, 0) + packing.piece_cost(n)
        at += n
    spread = lambda c: np.std(list(c)) / np.mean(list(c))
    full = [c for c in cost.values() if c > 4096]
    assert spread(full) < spread(first_fit.values())


def test_token_counts(spark):
    vocabulary = token_counts.zipf_vocabulary(PIECE)
    unigram = Tokenizer(models.Unigram([("<unk>", -60.0)] + vocabulary + [(f"<0x{i:02X}>", -90.0) for i in range(256)], unk_id=0, byte_fallback=True))
    rows = token_counts.count_tokens(docs(spark), PIECE).collect()
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in rows}
    for key, text in ROWS:
        words = [token_counts.SPACE + w for w in (text or "").split()]
        assert got[key] == (len(words), sum(len(unigram.encode(w).ids) for w in words))
    counter = token_counts.UnigramCounter(vocabulary)
    words = sorted({token_counts.SPACE + w for _, t in ROWS for w in (t or "").split()} | {"▁" + "xyz" * 9, "▁日本"})
    assert counter.trie(words) == [counter.one(w) for w in words]
    assert token_counts.count_tokens(docs(spark, []), PIECE).count() == 0


def test_pieces_are_cut_only_if_no_sequence_has_room():
    """Against a search over all sequences, for many sequences that are nearly full."""
    rng, n_cut = random.Random(6), 0
    for trial in range(30):
        lengths = [rng.randint(1, 63) if trial % 2 else rng.choice((5, 23, 29, 41)) for _ in range(300)]
        got = packing.pack_lengths(lengths, 64)
        total = sum(lengths)
        room = [64] * (total // 64) + [1 << b for b in range(5, -1, -1) if total % 64 >> b & 1]
        free, cost = list(room), [0.0] * len(room)
        rest = sorted((-n, doc, 0) for doc, n in enumerate(lengths))
        want = []
        while rest:
            n, doc, start = rest.pop(0)
            fits = [i for i, r in enumerate(free) if r >= -n] or [i for i, r in enumerate(free) if r]
            i = min(fits, key=lambda i: (cost[i], -room[i], i))
            size = min(-n, free[i])
            want.append((doc, start, size, i, room[i] - free[i]))
            free[i] -= size
            cost[i] += packing.piece_cost(size)
            if size < -n:
                rest = sorted([*rest, (n + size, doc, start + size)])
                n_cut += 1
        assert got == want
    assert n_cut


def test_rests_of_a_task_are_pooled(spark, monkeypatch):
    """Only the last shard of a task has sequences below the full length."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 6000)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("a", "word", "of", "text")) for _ in range(rng.choice((3, 40, 700, 9000)))) if i % 9 else None) for i in range(120)]
    got = packing.pack(docs(spark, rows).coalesce(1).repartition(4), WORD, with_ids=True).collect()
    by_doc = check_packing(got, [ids_of(WORD, t) for _, t in rows])
    for key, text in rows:
        [pieces] = [v for (k, _), v in by_doc.items() if k == key]
        assert [i for r in sorted(pieces, key=lambda r: r.start) for i in r.ids] == ids_of(WORD, text)
    size = {}
    for r in got:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    short = [q >> 33 for q, n in size.items() if n < packing.SEQUENCE_TOKENS]
    assert len(short) <= 12 * len(set(short)) and all(short.count(t) == len({n for q, n in size.items() if q >> 33 == t and n < packing.SEQUENCE_TOKENS}) for t in set(short))


def test_clashing_hashes_do_not_make_a_piece(monkeypatch):
    monkeypatch.setattr(token_counts, "_B", np.uint64(1))  # a hash that anagrams share
    counter = token_counts.UnigramCounter([("▁ab", -1.0), ("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0)])
    words = ["▁ba", "▁ab", "▁aab", "▁abba"]
    assert counter.trie(words) == [counter.one(w) for w in sorted(words)]
