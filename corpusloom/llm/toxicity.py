"""Toxicity scores from a bidirectional gated recurrent network, written in numpy.

A word enters as an embedding of its own, if the training rows taught it, beside the mean
embedding of its four-byte pieces, so that unseen forms of a word still count. One GRU
reads a window of words forwards and one backwards, attention weights their states, and a
logistic unit scores the pooled state. A text is covered by overlapping windows of
``WINDOW`` words every ``STRIDE`` words, all are scored, and the text's score is its
highest window's.

Training takes a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN``, the
first by a hash of doc_id) in one task. Where the texts of a class have more than
``MAX_CHARS`` characters, the longest ones teach by ``PIECES`` stretches spread over all of
the text, as long as that bound allows; every row of the sample teaches. Scoring is a map
over all rows. Of unlike texts with one doc_id the one
of the least hash teaches, so the model depends on the rows alone; a doc_id with unlike
labels counts as toxic. A null or empty text, or one without words, has the score of an
empty window; a text of any length is scored whole, by the same windows as if it were
handled at once. Words of more than ``MAX_WORD`` bytes count as several. Rows that repeat
are scored alike. With
no labelled rows of both classes every score is 0; an empty table gives no rows. Input
columns may have any names; one named like the score column is replaced by it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, inner, spread

WINDOW, STRIDE = 64, 56
#: Labelled rows that training reads at most.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: Characters of their texts at most, for each class, and stretches of a text beyond it.
MAX_CHARS, PIECES = 24_000_000, 16
#: A text at or above this score is toxic.
THRESHOLD = 0.7

HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BITS = 8, 8, 8, 15
#: Passes over the training windows at least, and weight updates at least.
EPOCHS, STEPS = 10, 90
BATCH, RATE = 256, 0.02
#: Training texts that a word needs for an embedding of its own.
MIN_TEXTS = 3
#: Bytes of text that one scoring step handles, and of a word.
STEP_BYTES, MAX_WORD = 3_000_000, 4096
#: Windows that run side by side.
LANES = 2048

_P = 0x100000001B3
_WORD_BYTE = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def _powers(n: int) -> np.ndarray:
    """P**i modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _P, dtype=np.uint64)
        up[0] = 1
        return np.cumprod(up)


_LONG = re.compile(rb"[0-9A-Za-z\x80-\xff]{%d}(?=[0-9A-Za-z\x80-\xff])" % MAX_WORD)


def _raw(text: str) -> bytes:
    """A text in lower case, with a gap after every MAX_WORD bytes of a word."""
    raw = text.lower().encode("utf-8", "replace")
    if len(raw) > MAX_WORD:
        gaps = np.flatnonzero(~_WORD_BYTE[np.frombuffer(raw, dtype=np.uint8)])
        if np.diff(gaps, prepend=-1, append=len(raw)).max() > MAX_WORD + 1:
            raw = _LONG.sub(rb"\g<0>\n", raw)
    return raw


class Words:
    """The words of some texts: their distinct forms, and for each word its form and text."""

    def __init__(self, texts: list[str | bytes]):
        raw = [t if isinstance(t, bytes) else _raw(t) for t in texts]
        data = np.frombuffer(b"\0\0" + b"\n".join(raw) + b"\0\0\0\0", dtype=np.uint8)
        inside = _WORD_BYTE[data]
        inside[:2] = inside[-4:] = False
        edge = np.diff(inside.astype(np.int8))
        start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        with np.errstate(over="ignore"):
            up = _powers(int((end - start).max(initial=0)) + 1)
            place = np.zeros(len(data), dtype=np.int32)
            place[start] = start
            np.maximum.accumulate(place, out=place)
            np.subtract(np.arange(len(data), dtype=np.int32), place, out=place)
            np.minimum(place, len(up) - 1, out=place)
            term = data.astype(np.uint64)
            term += np.uint64(1)
            term *= up[place]
            del place
            # every second sum is what lies between two words
            hashes = np.add.reduceat(term, np.stack([start, end], axis=1).ravel())[::2] if len(start) else np.zeros(0, dtype=np.uint64)
            del term
        self.hashes, first, self.form = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = np.array([len(r) + 1 for r in raw])
        begins = 2 + np.cumsum(sizes) - sizes
        self.text = np.searchsorted(begins, start, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        # the four-byte pieces of each distinct form, with one separator on either side
        bucket = np.where(inside, data, np.uint8(0)).astype(np.uint32)
        for step in (1, 2):  # two doublings join four bytes
            bucket = bucket[:-step] | (bucket[step:] << np.uint32(8 * step))
        n = np.maximum(end[first] - start[first] - 1, 1)
        at = np.cumsum(n) - n
        self.piece_at, self.piece_n = at, n
        pieces = bucket[np.repeat(start[first] - 1 - at, n) + np.arange(int(n.sum()))]
        pieces[at[end[first] - start[first] == 1]] &= np.uint32(0xFFFFFF)  # nothing of the next word
        pieces *= np.uint32(2654435761)
        self.pieces = (pieces >> np.uint32(32 - CHAR_BITS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, text) of every window; a text without words has none."""
        n = np.where(self.counts > 0, np.maximum(1, -(-(self.counts - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        first = (np.cumsum(self.counts) - self.counts)[text] + k * STRIDE
        return first, np.minimum(WINDOW, self.counts[text] - k * STRIDE), text


def _steps(words: Words, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Forms of windows sorted from long to short as (step, window), and how many windows
    have each step."""
    steps = np.arange(size[0])
    forms = words.form[np.minimum(first + steps[:, None], len(words.form) - 1)]
    return forms, np.searchsorted(-size, -steps, side="left").tolist()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Model:
    def __init__(self, vocabulary: np.ndarray, weights: dict[str, np.ndarray]):
        self.vocabulary, self.w = vocabulary, weights

    # ------------------------------------------------------------------ inputs
    def lookup(self, words: Words) -> np.ndarray:
        """Row of the word table for every distinct form; 0 for unknown words."""
        if not len(self.vocabulary):
            return np.zeros(len(words.hashes), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == words.hashes, i + 1, 0)

    def inputs(self, words: Words, rows: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.w["char"][words.pieces], words.piece_at, axis=0) / words.piece_n[:, None]
        return np.concatenate([self.w["word"][rows], chars], axis=1).astype(np.float32)

    # ----------------------------------------------------------------- network
    # Windows are sorted from long to short, so those that have a step come first:
    # ``alive`` counts them for each step.
    def _run(self, gates: np.ndarray, recur: np.ndarray, forms: np.ndarray, alive: list[int], steps, states: np.ndarray, keep: dict | None) -> None:
        """The states of one direction; ``forms`` (step, window) are rows of ``gates``."""
        h = np.zeros((forms.shape[1], HIDDEN), dtype=np.float32)
        for t in steps:
            k = alive[t]
            a, old = gates[forms[t, :k]], h[:k]
            b = old @ recur
            zr = a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, u = zr[:, :HIDDEN], zr[:, HIDDEN:], b[:, 2 * HIDDEN :]
            c = r * u
            c += a[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep is not None:
                keep[t] = (old.copy(), z, r, u, c)
            new = states[t, :k]
            np.subtract(old, c, out=new)
            new *= z
            new += c
            h[:k] = new

    def forward(self, x: np.ndarray, forms: np.ndarray, alive: list[int], keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``forms`` is (step, window)."""
        w, n = self.w, forms.shape[1]
        states = np.zeros((2, len(forms), n, HIDDEN), dtype=np.float32)
        for d, steps in ((0, range(len(forms))), (1, range(len(forms) - 1, -1, -1))):
            gates = x @ w["gate"][d] + w["gate_bias"][d]
            own: dict | None = {} if keep is not None else None
            self._run(gates, w["recur"][d], forms, alive, steps, states[d], own)
            if keep is not None:
                keep[d] = own
        e = states[0] @ w["attend"][:HIDDEN] + states[1] @ w["attend"][HIDDEN:]
        mask = np.arange(n) < np.asarray(alive)[:, None]
        p = np.exp(e - np.where(mask, e, -np.inf).max(axis=0)) * mask
        p /= p.sum(axis=0)
        pooled = np.concatenate([np.einsum("tn,tnk->nk", p, states[d]) for d in (0, 1)], axis=1)
        if keep is not None:
            keep.update(states=states, p=p, pooled=pooled)
        return pooled @ w["out"] + w["bias"][0]

    def backward(self, x: np.ndarray, forms: np.ndarray, alive: list[int], keep: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the rows of ``x`` for d loss / d logit."""
        w, n = self.w, forms.shape[1]
        both, p, pooled = np.concatenate(keep["states"], axis=2), keep["p"], keep["pooled"]
        g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()])}
        back = slope[:, None] * w["out"]
        e_slope = p * (np.einsum("tnk,nk->tn", both, back) - np.einsum("nk,nk->n", pooled, back))
        g["attend"] = np.einsum("tnk,tn->k", both, e_slope)
        state_slope = (p[:, :, None] * back + e_slope[:, :, None] * w["attend"]).astype(np.float32)
        g |= {k: np.zeros_like(w[k]) for k in ("gate", "gate_bias", "recur")}
        x_slope = np.zeros_like(x)
        order = np.argsort(forms, axis=None, kind="stable")
        rows, starts = np.unique(forms.ravel()[order], return_index=True)
        for d, steps in ((0, range(len(forms) - 1, -1, -1)), (1, range(len(forms)))):
            flow = np.zeros((n, HIDDEN), dtype=np.float32)
            side = np.zeros((len(forms), n, 3 * HIDDEN), dtype=np.float32)
            for t in steps:
                k = alive[t]
                h, z, r, u, c = keep[d][t]
                live = flow[:k] + state_slope[t, :k, d * HIDDEN : (d + 1) * HIDDEN]
                dc = live * (1 - z) * (1 - c * c)
                dz, dr = live * (h - c) * z * (1 - z), dc * u * r * (1 - r)
                side[t, :k] = np.concatenate([dz, dr, dc], axis=1)
                rec = np.concatenate([dz, dr, dc * r], axis=1)
                g["recur"][d] += h.T @ rec
                flow[:k] = live * z + rec @ w["recur"][d].T
            gate_slope = np.add.reduceat(side.reshape(-1, 3 * HIDDEN)[order], starts, axis=0)
            g["gate"][d] = x[rows].T @ gate_slope
            g["gate_bias"][d] = gate_slope.sum(axis=0)
            x_slope[rows] += gate_slope @ w["gate"][d].T
        return g, x_slope

    # ----------------------------------------------------------------- scoring
    def logits(self, texts: list[str | bytes]) -> np.ndarray:
        """The highest window's logit of every text."""
        out = np.full(len(texts), self.w["bias"][0], dtype=np.float64)
        words = Words(texts)
        if not len(words.form):
            return out
        x = self.inputs(words, self.lookup(words))
        first, size, text = words.windows()
        best = np.full(len(texts), -np.inf)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            forms, alive = _steps(words, first[some], size[some])
            np.maximum.at(best, text[some], self.forward(x, forms, alive))
        return np.where(np.isfinite(best), best, out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; a very long text is handled in stretches of its windows."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            for part in _stretches(_raw(t or "")):
                parts.append(part)
                owner.append(i)
        best, at = np.full(len(texts), -np.inf), 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= STEP_BYTES):
                size += len(parts[end])
                end += 1
            np.maximum.at(best, owner[at:end], self.logits(parts[at:end]))
            at = end
        return _sigmoid(best)


def _stretches(raw: bytes) -> Iterator[bytes]:
    """A text in stretches of at most about ``STEP_BYTES``, each of which holds whole windows
    of the text and begins where a window does: together they have the text's windows."""
    if len(raw) <= STEP_BYTES:
        yield raw
        return
    inside = _WORD_BYTE[np.frombuffer(raw, dtype=np.uint8)]
    start = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
    del inside
    first = 0
    while True:
        # as many windows as fit, one at least
        room = int(np.searchsorted(start, start[first] + STEP_BYTES)) - first if len(start) else 0
        last = first + max(0, (room - WINDOW - 1) // STRIDE) * STRIDE + WINDOW
        if last >= len(start):
            yield raw[start[first] :] if len(start) else b""
            return
        yield raw[start[first] : start[last]]
        first = last - WINDOW + STRIDE


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit the network; a toxic text teaches by its highest window, a clean one by several."""
    rng = np.random.default_rng(seed)
    words = Words(texts)
    y = np.asarray(labels, dtype=np.float32)
    pairs = np.unique(words.text.astype(np.int64) * len(words.hashes) + words.form)
    of, form = pairs // len(words.hashes), pairs % len(words.hashes)
    n_toxic, n_clean = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    toxic, clean = np.bincount(form, y[of], len(words.hashes)), np.bincount(form, 1 - y[of], len(words.hashes))
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    known = toxic + clean >= MIN_TEXTS
    piece_text = np.repeat(np.arange(len(words.hashes)), words.piece_n)
    piece_toxic = np.bincount(words.pieces, toxic[piece_text], 1 << CHAR_BITS)
    piece_clean = np.bincount(words.pieces, clean[piece_text], 1 << CHAR_BITS)
    piece_odds = np.log((piece_toxic + 1) / (n_toxic + 1)) - np.log((piece_clean + 1) / (n_clean + 1))
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    dim = WORD_DIM + CHAR_DIM
    w = {"word": draw(int(known.sum()) + 1, WORD_DIM), "char": draw(1 << CHAR_BITS, CHAR_DIM), "gate": draw(2, dim, 3 * HIDDEN) * 2, "gate_bias": np.zeros((2, 3 * HIDDEN), dtype=np.float32), "recur": draw(2, HIDDEN, 3 * HIDDEN) * 2, "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.array([-1.0], dtype=np.float32)}
    # what the labels say of a word and of its pieces alone is a good first embedding
    w["word"][0] = 0
    w["word"][1:, 0] = np.clip(odds[known], -3, 6) / 3
    w["char"][:, 0] = np.clip(piece_odds, -3, 6) / 3
    model = Model(words.hashes[known], w)
    rows = model.lookup(words)
    first, size, text = words.windows()
    if not len(text):
        return model
    toxic_text = y[text] > 0
    peak = np.array([odds[words.form[f : f + n]][known[words.form[f : f + n]]].max(initial=-9) for f, n in zip(first.tolist(), size.tolist())])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    n_windows = int(y.sum() + (1 - y).sum()) + min(2 * len(y), int((~toxic_text).sum()))
    epochs = max(EPOCHS, -(-STEPS * BATCH // n_windows))
    for epoch in range(epochs):
        order = np.lexsort((-peak, text))
        top = order[np.unique(text[order], return_index=True)[1]]
        chosen = np.concatenate([top, rng.choice(np.flatnonzero(~toxic_text), min(2 * len(top), int((~toxic_text).sum())), replace=False)]) if (~toxic_text).any() else top
        rng.shuffle(chosen)
        rate = RATE * (1 - epoch / epochs) + 0.001
        for at in range(0, len(chosen), BATCH):
            some = chosen[at : at + BATCH]
            some = some[np.argsort(-size[some], kind="stable")]
            flat, alive = _steps(words, first[some], size[some])
            forms, local = np.unique(flat, return_inverse=True)
            local = local.reshape(flat.shape)
            row = np.where(rng.random(len(forms)) < 0.3, 0, rows[forms])  # hide some words, so that pieces learn too
            n = words.piece_n[forms]
            begin = np.cumsum(n) - n
            piece = words.pieces[np.repeat(words.piece_at[forms] - begin, n) + np.arange(int(n.sum()))]
            x = np.concatenate([w["word"][row], np.add.reduceat(w["char"][piece], begin, axis=0) / n[:, None]], axis=1).astype(np.float32)
            keep: dict = {}
            p = _sigmoid(model.forward(x, local, alive, keep))
            target = y[text[some]]
            weight = np.where(target > 0, 1.5, 1.0)
            g, xg = model.backward(x, local, alive, keep, ((p - target) * weight / len(some)).astype(np.float32))
            word_rows, inverse = np.unique(row, return_inverse=True)
            word_g = np.zeros((len(word_rows), WORD_DIM), dtype=np.float32)
            np.add.at(word_g, inverse, xg[:, :WORD_DIM])
            piece_rows, inverse = np.unique(piece, return_inverse=True)
            piece_g = np.zeros((len(piece_rows), CHAR_DIM), dtype=np.float32)
            np.add.at(piece_g, inverse, np.repeat(xg[:, WORD_DIM:] / n[:, None], n, axis=0))
            step += 1
            for k, grad, r in [*((k, v, slice(None)) for k, v in g.items()), ("word", word_g, word_rows), ("char", piece_g, piece_rows)]:
                m, v = moment[k]
                m[r] = 0.9 * m[r] + 0.1 * grad
                v[r] = 0.99 * v[r] + 0.01 * grad * grad
                w[k][r] -= (rate * (m[r] / (1 - 0.9**step)) / (np.sqrt(v[r] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if epoch >= 3:  # later epochs take the window that the network itself finds highest
            w["word"][0] = 0
            x = model.inputs(words, rows)
            clean_windows = np.flatnonzero(~toxic_text) if epoch % 3 == 0 else np.zeros(0, dtype=np.int64)
            look = np.concatenate([np.flatnonzero(toxic_text), clean_windows])
            look = look[np.argsort(-size[look], kind="stable")]
            for at in range(0, len(look), LANES):
                some = look[at : at + LANES]
                peak[some] = model.forward(x, *_steps(words, first[some], size[some]))
    w["word"][0] = 0
    return model


def _train_map():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, t or "", y) for b in batches for k, t, y in zip(*(b.column(i).to_pylist() for i in range(3))))  # by id: the order of training is fixed
        y = np.array([r[2] for r in rows])
        if len(y) and 0 < y.sum() < len(y):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1] for r in rows], y))], pa.binary())], names=["model"])

    return run


def held_out(column: str = "doc_id"):
    """Rows that never teach: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _level(sizes: list[int]) -> int:
    """The length up to which texts teach whole so that all have ``MAX_CHARS`` characters."""
    left = MAX_CHARS
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return max(PIECES, left // (len(sizes) - i))
        left -= n
    return max(sizes, default=0) + PIECES


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> bytes | None:
    """A pickled model of a bounded sample of the labelled rows that may teach."""
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).cast("long").alias("_id")).agg(F.max(label_column).cast("int").alias("_y"))
    by_hash = lambda y, n: known.where(F.col("_y") == y).orderBy(F.md5(F.col("_id").cast("string"))).limit(n)
    sample = by_hash(1, MAX_TOXIC).union(by_hash(0, MAX_CLEAN))
    # at most MAX_TOXIC + MAX_CLEAN ids, so the texts need no shuffle
    rows, column = inner(docs)
    texts = rows.select(F.col(column[id_column]).cast("long").alias("_id"), F.coalesce(F.col(column[text_column]).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(sample), "_id")
    teachers = texts.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t").alias("t"))).alias("x"))
    teachers = cut(teachers.select("_id", "_y", F.col("x.t").alias("_t")))
    sizes = teachers.select("_y", F.length("_t")).collect()  # a number a row of the sample
    levels = [_level([n for y, n in sizes if y == k]) for k in (0, 1)]
    most = F.when(F.col("_y") == 1, levels[1]).otherwise(levels[0])
    piece, n = F.floor(most / PIECES).cast("int"), F.length("_t")
    spread_out = F.concat_ws("\n", *[F.col("_t").substr((F.floor((n - piece) * i / (PIECES - 1)) + 1).cast("int"), piece) for i in range(PIECES)])
    bounded = teachers.select("_id", F.when(n > most, spread_out).otherwise(F.col("_t")).alias("_t"), "_y")
    found = bounded.repartition(1).mapInArrow(_train_map(), "model binary").collect()
    return bytes(found[0][0]) if found else None


def score(docs: DataFrame, model: bytes | None, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """The columns of ``docs`` and a double ``score_column``."""
    kept = [c for c in docs.columns if c.lower() != score_column.lower()]
    rows, column = inner(docs.drop(score_column))
    shape = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, bounded by the training sample
    at = rows.columns.index(column[text_column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(held.value) if held.value else None
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                texts = part.column(at).to_pylist()
                scores = net.scores(texts) if net else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=shape.names)

    return spread(rows).mapInArrow(run, shape).toDF(*kept, score_column)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
