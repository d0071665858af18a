"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpusloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, key string"


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if _near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def _texts(rng, n):
    stems = ["".join(rng.choice("abcdeÉé×") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = stems[min(39, int(rng.expovariate(0.15)))]
            if rng.random() < 0.1:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "Z" + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.05 else w)
        yield i, " ,.\n"[rng.randrange(4)].join(words)


@pytest.mark.parametrize("crowd", [64, 2])
def test_same_as_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rows = list(_texts(random.Random(crowd), 300))
    rows += [(5, rows[5][1]), (None, rows[6][1]), (7, None), (8, ""), (9, "1 2 3"), (10, "Abcdefgh " * 20_000 + " ".join(["x" * 9000, "x" * 8999] * 2))]
    # words that share their first half, by hundreds
    rows += [(100 + i, f"interna{a}{b}e interna{a}{b}e") for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqrst")]
    df = spark.createDataFrame([(*r, "w", "n", "k") for r in rows], SCHEMA)
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows)


def test_chains_and_ties(spark):
    rows = [(1, "abcdefg " * 2 + "abcdefgh " * 20 + "abcdefghi " * 200 + "zbcdefg " * 2 + "bcdefghi " * 200)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == _plain(rows)
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
