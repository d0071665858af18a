"""Whole-text encoding with the tokenizers library inside Spark tasks.

A corpus repeats words far more often than it adds new ones, so a task encodes each
distinct word once with the library and joins the remembered ids. A text is only cut at
places where the tokenizer itself always cuts: in texts of Latin letters, ASCII digits and
punctuation, between letters, digits and punctuation; in other texts, at single spaces
between characters that are not white space. A text that fits neither goes to the library
whole, as does one that holds the content of a special token. Words are remembered by
their bytes; hashes only group the words of one batch, and every grouped word is compared
with the word that stands for its group.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words remembered by one Python worker before the memory is emptied.
MEMO_WORDS = 800_000
#: Words joined into one text for the library.
JOINED_WORDS = 1000
#: Characters of simple texts that are cut and looked up together.
STEP_CHARS = 1_500_000

# without U+0130, which becomes two characters in lower case
_LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f"
_OTHER = re.compile(f"[^ \\n!-&(-~{_LATIN}]")
# kinds of bytes in a simple text; a byte over 127 is part of a letter
_SPACE, _LINE, _LETTER, _DIGIT, _SIGN = range(5)
_KIND = np.array([_SPACE if i == 32 else _LINE if i == 10 else _DIGIT if 48 <= i <= 57 else _LETTER if i > 127 or chr(i).isalpha() else _SIGN for i in range(256)], dtype=np.int8)
_P = np.uint64(0x9E3779B97F4A7C15)
_UNSURE = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
#: White space beside a space or at either end: such texts are not cut.
_AFTER, _BEFORE, _ENDS = (re.compile(p) for p in (f" [{_UNSURE}]", f" (?<=[{_UNSURE}] )", f"^[{_UNSURE}]|[{_UNSURE}]\\Z"))


def regular(text: str) -> bool:
    """Whether every space in ``text`` is a place where the tokenizer cuts."""
    return not (_ENDS.search(text[:1]) or _ENDS.search(text[-1:]) or _AFTER.search(text) or _BEFORE.search(text))


def simple(text: str) -> bool:
    """Whether ``text`` is of the kind that is cut between letters, digits and punctuation."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _OTHER.search(text))


class WordEncoder:
    """``encode(texts)`` gives the little-endian 16- or 32-bit ids of each whole text."""

    def __init__(self, path: str, spaced: bool):
        """path: a tokenizers JSON file. spaced: a word's leading space belongs to its
        tokens (byte-level BPE); otherwise white space is dropped and each word's last
        token is marked as such."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        #: Tokens that begin (spaced) or end (otherwise) a word of a joined text.
        self.edge = np.array([x.startswith("Ġ") if spaced else x.endswith("</w>") for x in names])
        self.line = names.index("Ċ") if spaced else None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        #: Characters one of which a text with a special token holds.
        self.marks = {t[0].lower() for t in added} | {t[0].upper() for t in added}
        #: Ids by a word's bytes.
        self.memo: dict[bytes, bytes] = {}
        self.recent: list[bytes] = []

    def settle(self) -> None:
        """At the end of a task: keep the words of the last texts, among them all frequent
        ones, and free the rest, as the worker may go on to other work."""
        self.memo = {k: self.memo[k] for k in self.recent if k in self.memo}
        self.recent = []

    def _has_special(self, text: str) -> bool:
        return any(c in text for c in self.marks) and self.special.search(text) is not None

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _separately(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, dtype=self.dtype).tobytes() for ids in self._library(words)]

    def _together(self, words: list[str], between: str) -> list[bytes]:
        """Encode words in one text, and cut its ids again where a word begins or ends."""
        out: list[bytes] = []
        for i in range(0, len(words), JOINED_WORDS):
            part = words[i : i + JOINED_WORDS]
            ids = np.array(self._library([between.join(part)])[0], dtype=self.dtype)
            if between == "\n":
                ends = np.append(np.flatnonzero(ids == self.line), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            elif self.spaced:
                starts = np.flatnonzero(self.edge[ids])
                ends = np.append(starts[1:], len(ids))
            else:
                ends = np.flatnonzero(self.edge[ids]) + 1
                starts = np.append(0, ends[:-1])
            if len(starts) != len(part) or len(ends) != len(part):
                out += self._separately(part)
                continue
            flat, width = ids.tobytes(), self.dtype.itemsize
            out += map(flat.__getitem__, map(slice, (starts * width).tolist(), (ends * width).tolist()))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each one piece for the tokenizer."""
        if not self.spaced:
            return self._together(words, " ")
        out: list[bytes] = [b""] * len(words)
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(words):
            kinds[0 if w[0] == " " else 1 if w != "\n" else 2].append(i)
        for at, encoded in ((kinds[0], "" if kinds[0] else None), (kinds[1], "\n" if kinds[1] else None)):
            if encoded is not None:
                for i, ids in zip(at, self._together([words[i] for i in at], encoded)):
                    out[i] = ids
        for i, ids in zip(kinds[2], self._separately([words[i] for i in kinds[2]])):
            out[i] = ids
        return out

    def _simple(self, texts: list[str]) -> list[bytes]:
        """Ids of simple texts: pieces are cut, hashed and looked up all together."""
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        kind = _KIND[data]
        new = np.empty(len(data), dtype=bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        if self.spaced:
            new[1:] &= kind[:-1] != _SPACE  # a space belongs to what follows it
        else:
            new |= kind == _DIGIT
        begins = np.cumsum(sizes) - sizes
        new[begins] = True
        new[begins + sizes - 1] = True  # the line end after each text
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(data))
        with np.errstate(over="ignore"):
            length = end - at
            power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(int(length.max()), _P, dtype=np.uint64)]))
            term = data.astype(np.uint64)
            term += np.uint64(1)
            term *= power[np.arange(len(data)) - np.repeat(at, length)]
            hashes = np.add.reduceat(term, at) ^ (length.astype(np.uint64) << np.uint64(48))
        keep = np.ones(len(at), dtype=bool)
        if not self.spaced:
            keep = (kind[at] != _SPACE) & (kind[at] != _LINE)
        keep[np.searchsorted(at, begins + sizes - 1)] = False
        at, end, hashes = at[keep], end[keep], hashes[keep]
        _, first, form = np.unique(hashes, return_index=True, return_inverse=True)
        apart = self._unlike(data, at, end, first[form])
        first = np.append(first, apart)
        form[apart] = np.arange(len(first) - len(apart), len(first))
        whole = data.tobytes()
        keys = list(map(whole.__getitem__, map(slice, at[first].tolist(), end[first].tolist())))
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if lost := list(dict.fromkeys(k for k in keys if k not in self.memo)):
            self.memo.update(zip(lost, self._words([k.decode() for k in lost])))
        self.recent = keys
        found = list(map(self.memo.__getitem__, keys))
        width = self.dtype.itemsize
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // width
        flat = np.frombuffer(b"".join(found), dtype=self.dtype)
        start, n_piece = (np.cumsum(n) - n)[form], n[form]
        upto = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(n_piece)])
        ids = flat[np.repeat(start - upto[:-1], n_piece) + np.arange(int(upto[-1]))].tobytes()
        cuts = (upto[np.searchsorted(at, np.append(begins, len(data)))] * width).tolist()
        return [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:])]

    @staticmethod
    def _unlike(data: np.ndarray, at: np.ndarray, end: np.ndarray, stand: np.ndarray) -> np.ndarray:
        """The words that differ from the word ``stand`` which has the same hash."""
        length = end - at
        other = at[stand]
        same = length == end[stand] - other
        n = np.where(same, length, 0)
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        differ = data[step + np.repeat(at - begin, n)] != data[step + np.repeat(other - begin, n)]
        if differ.any():
            same[np.searchsorted(begin + n, np.flatnonzero(differ), side="right")] = False
        return np.flatnonzero(~same)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, chars = [], 0

        def flush() -> None:
            nonlocal plain, chars
            if plain:
                for i, ids in zip(plain, self._simple([texts[i] for i in plain])):
                    out[i] = ids
            plain, chars = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if self._has_special(text):
                out[i] = self._separately([text])[0]
            elif simple(text):
                plain.append(i)
                chars += len(text)
                if chars >= STEP_CHARS:
                    flush()
            elif self.spaced and regular(text):
                words = text.split(" ")
                out[i] = b"".join([*self._separately(words[:1]), *self._together([" " + w for w in words[1:]], "")])
            else:
                out[i] = self._separately([text])[0]
        flush()
        return out


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, spaced: bool) -> WordEncoder:
    """One encoder a worker process, kept over its tasks."""
    key = (path, spaced)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, spaced)
    return _encoders[key]
