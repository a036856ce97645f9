"""Substring deduplication of words by seed and extend.

Documents are joined on winnowed anchors (grams of ``GRAM`` words picked as the
smallest hash of a window). From each shared anchor the match of two documents
is extended word by word both ways; a maximal repeat of at least ``WINDOW``
words is kept as a repeat. The later document loses its words.

Defined results: NULL text has no words. Words of the document with the smallest
doc_id stay; repeats inside one document stay. Rows with a NULL doc_id take no
part and stay whole. Rows that share a doc_id are the same document.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Ranges, Spec, mix, repeated

WINDOW = 13
GRAM = 7
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTES = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)


class Words(Spec):
    wide = 1

    def __init__(self, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram, self.pieces = window, gram, (1,)

    def units(self, text):
        """One hash per word, from one running sum over the bytes."""
        data = np.frombuffer(text.encode(), np.uint8)
        edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
        return Ranges(_BYTES[data])(edge[::2], edge[1::2]).view(np.uint64)

    def values(self, units):
        return units

    def grams(self, units, values):
        n = len(units) - self.gram + 1
        code = units[:n].copy()
        for j in range(1, self.gram):
            code *= np.uint64(0x9E3779B97F4A7C15)
            code += units[j:j + n]
        return mix(code)

    def cut(self, units, lo, hi):
        return units[lo:hi].tobytes()

    def compare(self, members, mode):
        """Extend from the anchor both ways. Two members are walked word by word;
        more are laid side by side, columns running from the anchor to the right
        and to the left, where a cell beyond a member's end equals no other."""
        k = len(members)
        words = [np.frombuffer(m[5], np.uint64) for m in members]
        lead = [m[3] for m in members]
        if k == 2:
            (x, y), (a, b) = (w.tolist() for w in words), lead
            right, left = _walk(x[a:], y[b:]), _walk(x[:a][::-1], y[:b][::-1])
            if left + right >= self.window:
                for i in (0, 1):
                    if mode != "earlier document" or members[1 - i][0] < members[i][0]:
                        yield i, lead[i] - left, lead[i] + right
            return
        doc = np.array([m[0] for m in members])
        right = self._extend([w[a:] for w, a in zip(words, lead)])
        left = self._extend([w[:a][::-1] for w, a in zip(words, lead)])
        keep = left + right >= self.window
        keep &= doc[None, :] < doc[:, None] if mode == "earlier document" else ~np.eye(k, dtype=bool)
        for i in np.flatnonzero(keep.any(axis=1)).tolist():
            found = np.unique(np.stack([left[i][keep[i]], right[i][keep[i]]]), axis=1)
            for a, b in found.T.tolist():
                yield i, lead[i] - a, lead[i] + b

    @staticmethod
    def _extend(rows):
        """Common prefix lengths of all pairs of rows."""
        size = np.array([len(r) for r in rows])
        table = np.zeros((len(rows), size.max(initial=0) + 1), np.uint64)
        for i, r in enumerate(rows):
            table[i, :len(r)] = r
        inside = np.arange(table.shape[1]) < size[:, None]
        same = (table[:, None] == table[None]) & inside[:, None] & inside[None]
        return np.argmin(same, axis=2)


def _walk(x: list[int], y: list[int]) -> int:
    n = 0
    for a, b in zip(x, y):
        if a != b:
            break
        n += 1
    return n


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text without the words repeated from an earlier document, the
    number of words and of removed words."""
    def finish(text, spans):
        kept, n, removed = kept_words(text, spans)
        return kept.decode(), n, removed
    return repeated(docs, Words(window), "earlier document", finish,
                    "text string, n_words long, n_removed long")


def kept_words(text: str | None, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The remaining words over single blanks, the words, and the removed ones."""
    ws = (text or "").encode().split()
    kept, at = [], 0
    for lo, hi in spans:
        kept += ws[at:lo]
        at = hi
    kept += ws[at:]
    return b" ".join(kept), len(ws), len(ws) - len(kept)


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    def finish(text, spans):
        kept, n, removed = kept_words(text, spans)
        return n, removed, hashlib.sha256(kept).hexdigest()
    return repeated(docs, Words(window), "earlier document", finish,
                    "n_words long, n_removed long, kept_sha256 string")
