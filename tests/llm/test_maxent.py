"""The maximum-entropy model: counts and base against plain Python, a proper distribution,
plain loops for its probabilities, and better scores of held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import maxent

SCHEMA = "doc_id long, text string, row long, h string, n string"


def _tokens(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] + [""]


def _base(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in _tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        words = _tokens(t)
        yield i, out(i), len(words), sum(w in c for w in words), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 6)


def _texts(n, seed=1):
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(200)] for k in "abcd"]
    return [(i, " ".join(rng.choice(kinds[i % 4])[: 1 + (rng.random() < 0.9) * 9] if rng.random() < 0.7 else "The" for _ in range(rng.randint(0, 120)))) for i in range(n)]


@pytest.mark.parametrize("top", [maxent.TOP, 50])
def test_counts_and_base_are_exact(spark, monkeypatch, top):
    monkeypatch.setattr(maxent, "TOP", top)
    monkeypatch.setattr(maxent, "_OTHER", top)
    monkeypatch.setattr(maxent, "_NONE", top + 1)
    monkeypatch.setattr(maxent, "WORDS", 30)
    rows = _texts(120) + [(5, _texts(120)[5][1]), (None, "the a1"), (300, None), (301, ""), (302, " \t\n"), (303, "Äé THE\x0bthe x \x1c 漢字"), (304, "a1 " * 60_000)]
    got = maxent.score(spark.createDataFrame([(*r, 1, "h", "n") for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = got.collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in found), key=repr) == sorted(_base(rows), key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_held_out_texts_score_better(spark):
    found = maxent.score(spark.createDataFrame(_texts(5000), "doc_id long, text string")).where("held_out").collect()
    assert len(found) > 100
    assert sum(r.score for r in found) > 0.97 * sum(r.base_score for r in found)
    assert sum(r.score > r.base_score for r in found if r.n_tokens > 20) > 0.95 * sum(r.n_tokens > 20 for r in found)


def test_edges(spark):
    assert maxent.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    none = next(i for i in range(100) if maxent.held_out(i))
    only = maxent.score(spark.createDataFrame([(none, "some words"), (none, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in only) == [(none, True, 1, 0, 0, 0.0, 0.0), (none, True, 3, 0, 0, 0.0, 0.0)]


def _model(rng):
    counts = np.sort(rng.integers(1, 500, 60))[::-1].astype(float)
    model = maxent.Model(counts, 300.0, maxent.classes(rng.integers(0, 50, (60, 9)).astype(float), 7))
    model.by_class += rng.normal(0, 1, model.by_class.shape).astype(np.float32)
    model.by_word += rng.normal(0, 1, model.by_word.shape).astype(np.float32)
    return model


def test_probabilities_are_those_of_plain_loops_and_sum_to_one():
    model = _model(np.random.default_rng(3))
    for a, b in ((3, 9), (maxent._NONE, maxent._NONE), (maxent._OTHER, 59)):
        ids = np.array([*range(60), maxent._OTHER])
        rows = model.features([np.full(61, a), np.full(61, b)])
        got = model.log_probabilities(ids, rows)
        assert abs(np.exp(got).sum() - 1) < 1e-4
        logits = [float(model.class_bias[k]) + sum(float(model.by_class[r[0], k]) for r in rows[0]) for k in range(model.classes + 1)]
        total = sum(map(math.exp, logits))
        for w in (0, 17, 59):
            k = model.kind[w]
            inside = [math.exp(float(model.word_bias[s]) + sum(float(model.by_word[r[0], s]) for r in rows[1])) for s in range(model.start[k], model.start[k + 1])]
            assert abs(got[w] - math.log(math.exp(logits[k]) / total * inside[model.slot[w] - model.start[k]] / sum(inside))) < 1e-3


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(4)
    model = _model(rng)
    ids = rng.integers(0, 60, 500)
    rows = model.features([rng.integers(0, 5, 500), rng.integers(0, 5, 500)])
    used = (np.zeros((maxent.CLASS_ROWS, 1), dtype=np.int64), np.zeros((maxent.WORD_ROWS, model.classes), dtype=np.int64))
    before = model.by_class.copy(), model.by_word.copy(), model.log_probabilities(ids, rows).sum()
    model.step(ids, rows, 1e-3, used)
    after = model.log_probabilities(ids, rows).sum()
    # the gain is the slope along the step, by differences of the log likelihood itself
    step = model.by_class - before[0], model.by_word - before[1]
    model.by_class, model.by_word = before[0] + 0.5 * step[0], before[1] + 0.5 * step[1]
    assert after > before[2] and abs((model.log_probabilities(ids, rows).sum() - before[2]) / (after - before[2]) - 0.5) < 0.1
    row = int(rows[0][0][0])
    model.by_class, model.by_word = before[0].copy(), before[1].copy()
    slope = -step[0][row] * ((rows[0] == row).sum() + maxent.PRIOR) / 1e-3
    for k in (0, 2, model.classes):
        model.by_class[row, k] += 0.05
        up = model.log_probabilities(ids, rows).sum()
        model.by_class[row, k] -= 0.1
        down = model.log_probabilities(ids, rows).sum()
        model.by_class[row, k] += 0.05
        assert abs((down - up) / 0.1 - slope[k]) < 0.05 + 0.02 * abs(slope[k])
    assert used[0].sum() == 3 * 500


def test_sums_by_group():
    rng = np.random.default_rng(5)
    flat = np.minimum(rng.zipf(1.3, 9000), 3000)
    values = rng.normal(size=(3000, 7))
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
    n = np.diff(starts, append=len(flat))
    assert np.allclose(maxent._group_sums(values, order % 3000, starts, n), np.add.reduceat(values[order % 3000], starts, axis=0))
