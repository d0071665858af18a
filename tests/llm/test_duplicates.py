"""Fingerprints, near-duplicates and components against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import common, components, hnsw, simhash, syncmers


def smallest(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = smallest({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for a, b in edges if a != b for n in (a, b)} == set(got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


WORDS = [w + v for w in "ab cd ef gh ij kl mn op qr st".split() for v in "aeiou"]


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 400))) for _ in range(n)]
    rows = list(base)
    for text in base[: n // 2]:
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        rows += [" ".join(words), text.upper(), text.replace(" ", "\t\n")]
    rows += ["", None, " \n ", "one", "ONE", "a" * 100_000]
    return [(i, t, "clash") for i, t in enumerate(rows)]


def brute_print(text, k=4):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_simhash(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)  # 2: nearly all buckets take the longer key
    rows = corpus()
    prints = {i: brute_print(t) for i, t, _ in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = smallest(prints, pairs)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, print string")).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], want[i]) for i in prints}
    assert len({want[i] for i in want}) < len(rows)


def test_simhash_links_at_every_distance(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), d)) for b in base for d in (1, 2, 3, 4, 5, 6)]
    all_ = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    got = {(r.x, r.y) for r in simhash.links(spark.createDataFrame([(x,) for x in all_], "print long")).collect()}
    assert got == {(a, b) for a in all_ for b in all_ if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}


def test_simhash_odd_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "quite another text of words"), (3, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "5", "None"]


def test_syncmers_are_context_free_and_closed():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef gh") for _ in range(400))
    inner = set(syncmers.syncmer_hashes(text).tolist())
    assert inner <= set(syncmers.syncmer_hashes("left " + text + " right").tolist())
    # brute force: the s-mer order is that of the operator's own hash
    k, s = syncmers.K, syncmers.S
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        order = syncmers._mix(syncmers._rolling(codes, s))
    n = sum(int(min(w := order[i : i + k - s + 1].tolist()) in (w[0], w[-1])) for i in range(len(text) - k + 1))
    assert len(syncmers.syncmer_hashes(text)) == n and 0.1 < n / len(text) < 0.4


def test_neighbours(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 600))) for _ in range(80)]
    texts[3] = texts[4]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (300, "é"), (302, "x" * 50_000)]
    got = {r.doc_id: r for r in syncmers.neighbour_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    order = sorted((k, t or "") for k, t in rows)
    assert len(got) == len(rows)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) >= (edited == text)
        a, b, c = (set(syncmers.syncmer_hashes(t).tolist()) for t in (text, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.near_edited - like(a, b)) < 0.2 and abs(r.near_next - like(a, c)) < 0.2
    assert got[9].fingerprint == got[12].fingerprint and got[9].near_next == 1.0
    single = syncmers.neighbour_likeness(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    assert syncmers.neighbour_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert alone == {k: r.fingerprint for k, r in got.items()}


@pytest.mark.parametrize("shard", [10_000, 60])
def test_hnsw_against_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.12  # a crowd
    x[200:230] = x[50]  # copies
    x[240:250] = x[5] * 7
    label = [int(v) for v in rng.integers(0, 2, 300)]
    label[0:1], label[100:160], label[200:230] = [1], [1] * 60, [label[50]] * 30
    rows = [(i, [float(c) for c in np.float32(v)], lab) for i, (v, lab) in enumerate(zip(x, label))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, rows[0][1], None), (None, rows[0][1], 1), (905, [float("inf")] + [0.0] * 15, 1), (906, rows[0][1][:8], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hnsw.near_duplicates(df, shard_rows=shard).collect()
    assert len(got) == len(rows)
    ok = [r for r in rows[:300]]
    u = np.array([r[1] for r in ok])
    u /= np.linalg.norm(u, axis=1)[:, None]
    on = (u @ u.T >= hnsw.COSINE) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(on, False)
    want = smallest(range(300), zip(*np.nonzero(np.triu(on))))
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    found, true = sum(by[i].n_links for i in range(300)), int(on.sum())
    assert 0.97 * true <= found <= true and all(by[i].n_links <= on[i].sum() for i in range(300))
    assert sum(by[i].component_id == want[i] for i in range(300)) >= 297
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    for i in range(900, 907):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert hnsw.near_duplicates(df.where(F.col("vec_id") > 10_000)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph(24)
    for v in x:
        graph.add(v)
    hits = sum(int((x @ x[i]).argsort()[-2]) in {j for _, j in graph.search(x[i], 64)} for i in range(0, 1500, 15))
    assert hits >= 90


def test_deduplicate_joins_near_copies_and_leaves_the_rest(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(150, 400))] for _ in range(120)]
    rows, near = [], set()
    for i, words in enumerate(base):
        rows.append((i * 10, " ".join(words)))
        for j in range(1, i % 5):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "new"
            rows.append((i * 10 + j, " ".join(copy)))
            near.add(i * 10 + j)
    # half of another text is no near copy
    rows += [(5000 + i, " ".join(base[i][: len(base[i]) // 2] + [rng.choice(vocabulary) for _ in range(len(base[i]) // 2)])) for i in range(40)]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for k, _ in rows} - near


def jaccard_groups(rows):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    prints = {i: brute_print(text, 5) for i, text in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4]
    close = [(a, b) for a in sets for b in sets if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    return smallest(sets, pairs + close), len(pairs)


@pytest.mark.parametrize("common,crowded", [(simhash.COMMON, simhash.CROWDED), (2, simhash.CROWDED), (simhash.COMMON, 1)])
def test_deduplicate_is_exact_at_the_likeness(spark, monkeypatch, common, crowded):
    """Copies on both sides of likeness 0.8 (or within 4 bits), and a passage that many texts
    share; with ``CROWDED`` 1 every key asks for a second shared shingle."""
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "SAMPLE", 1 if common == 2 else 16)
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    passage, rows = rng.choices(vocabulary, k=60), []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice((6, 30, 150, 300))) + (passage if i % 3 else [])
        rows.append((i * 10, " ".join(words)))
        for j in range(1, 5):
            copy = list(words)
            for _ in range(len(words) * rng.randint(1, 6) // 200 + (j > 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 10 + j, " ".join(copy)))
    want, n = jaccard_groups(rows)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in want if want[i] == i} and 100 < n and len(kept) > 90


def test_large_family_of_unlike_copies_makes_few_pairs(spark, monkeypatch):
    """Lightly changed copies of one text, and copies changed too much to be near any: what is
    compared grows with the family, not with its square."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    base, rows = rng.choices(vocabulary, k=400), []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(5, 390, 5), rng.randint(10, 12) if i % 5 < 2 else rng.randint(0, 2)):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    compared = []
    for step in ("_promising", "_verified"):
        monkeypatch.setattr(simhash, step, lambda pairs, *rest, f=getattr(simhash, step): compared.append(pairs.count()) or f(pairs, *rest))
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, _ = jaccard_groups(rows)
    assert kept == {i for i in want if want[i] == i} and 50 < len(kept) < 150
    assert 0 < sum(compared) < 5 * len(rows)


def test_deduplicate_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choices(WORDS, k=80)) for _ in range(3))
    rows = [(1, a), (2, a.upper()), (2, b), (3, b + " end"), (3, c), (3, c)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(1, a), (2, b), (3, c)]


def test_filters_and_joins_keep_the_same_rows(spark, monkeypatch):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(40)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " end") for i, t in enumerate(base[:12])] + [(3, base[3]), (7, base[8]), (None, base[9]), (200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda: sorted(map(tuple, simhash.deduplicate(docs).collect()), key=repr)
    found = held()
    assert len(found) == 31
    monkeypatch.setattr(simhash, "MAX_BITS_HELD", 0)
    assert held() == found
    monkeypatch.setattr(simhash, "MAX_BITS_HELD", 1 << 28)
    monkeypatch.setattr(simhash, "HASH_BITS", 1)
    assert held() == found


def test_deduplicate_hands_workers_small_batches_and_leaves_no_keys(spark, monkeypatch):
    """The texts that executor and worker hold at once, and the keys on shared storage."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(150)]
    rows += [(1000 + i, t + " end") for i, t in rows[:40]]
    paths, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, written = spark.conf.get(key), common.scratch_path

    def bounded(made):
        def make(*args):
            run = made(*args)

            def checked(batches):
                for batch in batches:
                    assert batch.num_rows <= 16
                    yield from run(iter([batch]))

            return checked

        return make

    monkeypatch.setattr(simhash, "BATCH", 16)
    for step in ("_set_map", "_member_map"):
        monkeypatch.setattr(simhash, step, bounded(getattr(simhash, step)))
    monkeypatch.setattr(common, "scratch_path", lambda *a: paths.append(written(*a)) or paths[-1])
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows[:150]} and spark.conf.get(key) == before
    keys = [p for p in paths if "near-keys" in p]
    assert keys and not any(os.path.exists(p.removeprefix("file:")) for p in keys)


@pytest.mark.parametrize("few,crowded", [(1, 1), (8, 3), (10**9, 1)])
def test_deduplicate_is_exact_however_sets_meet(spark, monkeypatch, few, crowded):
    """Keys in many rounds; sets that meet key by key, under a pivot and by their consensus."""
    for name, value in (("FEW", few), ("CROWDED", crowded), ("KEYS_AT_ONCE", 5000), ("COMMON", 10**9)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(33)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    phrases, rows = [rng.choices(vocabulary, k=30) for _ in range(4)], []
    for i in range(50):
        words = rng.choices(vocabulary, k=rng.choice((6, 30, 150, 300))) + rng.choice(phrases) + rng.choice(phrases)
        rows.append((i * 10, " ".join(words)))
        for j in range(1, 5):
            copy = list(words) + rng.choices(vocabulary, k=rng.randrange(len(words) // 4 + 1) if j == 4 else 0)
            for _ in range(len(words) * rng.randint(1, 6) // 200 + (j > 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 10 + j, " ".join(copy)))
    want, n = jaccard_groups(rows)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in want if want[i] == i} and 80 < n and len(kept) > 70


def test_texts_that_share_phrases_by_chance_make_no_sets(spark, monkeypatch):
    """Long texts that hold a few phrases of many others share some keys and are not near."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    phrases = [rng.choices(vocabulary, k=10) for _ in range(6)]
    rows = []
    for i in range(200):
        words = rng.choices(vocabulary, k=rng.randint(500, 700))
        for phrase in rng.sample(phrases, 3):
            at = rng.randrange(len(words))
            words[at:at] = phrase
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, text + " end") for i, text in rows[:20]]
    wanted, make = [], simhash._sets
    monkeypatch.setattr(simhash, "COMMON", 10**9)  # no shingle is put last for being common
    monkeypatch.setattr(simhash, "_sets", lambda nodes, *rest: wanted.append(nodes.distinct().count()) or make(nodes, *rest))
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(200)) and 40 <= sum(wanted) < 60


def test_deduplicate_leaves_no_tables_and_no_shuffles(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=60))) for i in range(120)]
    rows += [(1000 + i, t + " end") for i, t in rows[:40]]
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, write = spark.conf.get(key), common.scratch_path
    monkeypatch.setattr(common, "scratch_path", lambda *a: seen.append((spark.conf.get(key), write(*a))) or seen[-1][1])
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(seen) > 5 and {k for k, _ in seen} == {"true"} and spark.conf.get(key) == before
    assert not any(os.path.exists(p.removeprefix("file:")) for _, p in seen)
    assert {r.doc_id for r in kept.collect()} == set(range(120))
