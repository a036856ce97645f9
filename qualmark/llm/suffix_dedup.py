"""Suffix-array deduplication of exact byte passages.

Within the texts that share an anchor, byte suffixes are sorted and neighbours
in suffix order give their common prefix. The previous and the next smaller
position in that order give, by the longest-previous-factor array, how much of
a suffix already occurs earlier; with the order of positions reversed, how much
occurs later. A window of ``WINDOW`` bytes is a copy if that factor is at least
as long. ``mode="earlier"`` removes later copies and keeps the first;
``mode="anywhere"`` removes every copy.

Suffixes are sorted sparsely first: one in ``STEP`` windows, compared on the
bytes all windows of the step share. Only where those agree are the suffixes in
between sorted too.

Defined results: NULL text is empty. Matches never cross documents. Repeated
rows are copies of each other. Rows with a NULL doc_id take no part and stay
whole. A cut may fall inside a character, so kept bytes are binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Spec, mix, repeated

WINDOW = 400
STEP = 16


def previous_factors(order: list[int], lcp: list[int]) -> list[int]:
    """Longest previous factor of every entry of a suffix order.

    ``order`` lists positions in suffix order, ``lcp[i]`` the common prefix of
    entries i - 1 and i (``lcp[0]`` unused). For an entry, the match with an
    earlier position that is longest lies at the nearest smaller position before
    or after it in suffix order; the length is the least lcp on the way there.
    Returns the lengths in suffix order."""
    n = len(order)
    best = [0] * n
    for step in (1, -1):
        stack: list[tuple[int, int]] = []  # positions rising, with the lcp to the entry below
        for i in range(n) if step == 1 else range(n - 1, -1, -1):
            here = i if step == 1 else i + 1
            low = lcp[here] if 0 < here < n else 0
            while stack and order[stack[-1][0]] > order[i]:
                low = min(low, stack.pop()[1])
            if stack and low > best[i]:
                best[i] = low
            stack.append((i, low))
    return best


def copies(suffixes: list[tuple], depth: int, mode: str) -> list[bool]:
    """Which of (text, position) have their whole ``text`` at another position
    that counts. Common prefixes are taken as ``depth`` or 0: less than the
    whole never counts."""
    n = len(suffixes)
    order = sorted(range(n), key=lambda i: suffixes[i])
    lcp = [0] + [depth if suffixes[a][0] == suffixes[b][0] else 0 for a, b in zip(order, order[1:])]
    place = [0] * n  # rank of each entry's position
    for r, i in enumerate(sorted(range(n), key=lambda i: suffixes[i][1])):
        place[i] = r
    at = [place[i] for i in order]
    found = previous_factors(at, lcp)
    if mode == "anywhere":
        later = previous_factors([-p for p in at], lcp)
        found = [max(a, b) for a, b in zip(found, later)]
    out = [False] * n
    for i, length in zip(order, found):
        out[i] = length >= depth
    return out


class Bytes(Spec):
    gram, wide = 64, 8

    def __init__(self, window: int = WINDOW, step: int = STEP) -> None:
        if window < self.gram:
            raise ValueError(f"windows have at least {self.gram} bytes")
        self.window, self.step, self.pieces = window, step, (3 * step, step // 2, 1)

    def units(self, text):
        return text.encode()

    def values(self, units):
        return mix(np.ndarray((max(0, len(units) - 7),), "<u8", units, strides=(1,)).astype(np.uint64))

    def grams(self, units, values):
        code, size = values, 8
        while size < self.gram:
            code = mix(code[:-size] * np.uint64(0x9E3779B97F4A7C15) + code[size:])
            size *= 2
        return code

    def cut(self, units, lo, hi):
        return units[lo:hi]

    def compare(self, members, mode):
        """Equal windows lie equally far before the shared gram, so only
        suffixes of equal distance meet: first one per step, then the others."""
        w, step = self.window, self.step
        sparse: dict[int, list[tuple]] = {}
        for i, (_, _, _, lead, count, data) in enumerate(members):
            for q in range((lead - count + 1) // step, lead // step + 1):
                core = lead - step * q
                sparse.setdefault(q, []).append((data[core:core - step + 1 + w], (i, core)))
        for suffixes in sparse.values():
            if len(suffixes) < 2:
                continue
            agree = copies(suffixes, w - step + 1, "anywhere")
            alike: dict[bytes, list[tuple[int, int]]] = {}
            for (shared, at), yes in zip(suffixes, agree):
                if yes:
                    alike.setdefault(shared, []).append(at)
            for group in alike.values():
                yield from self._dense(members, group, mode)

    def _dense(self, members, group, mode):
        w, step = self.window, self.step
        for back in range(step):
            suffixes, owner = [], []
            for i, core in group:
                p = core - back
                doc_id, text_id, at, _, count, data = members[i]
                if 0 <= p < count:
                    suffixes.append((data[p:p + w], (doc_id, text_id, at + p)))
                    owner.append((i, p))
            if len(suffixes) > 1:
                for (i, p), yes in zip(owner, copies(suffixes, w, mode)):
                    if yes:
                        yield i, p, p + w


def kept_bytes(text: str | None, spans: list[tuple[int, int]]) -> bytes:
    data, out, at = (text or "").encode(), [], 0
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def remove_copies(docs: DataFrame, window: int = WINDOW, mode: str = "earlier") -> DataFrame:
    """doc_id, kept (remaining bytes) and the removed byte ranges as start and
    end in turn."""
    def finish(text, spans):
        return kept_bytes(text, spans), [x for span in spans for x in span]
    return repeated(docs, Bytes(window), mode, finish, "kept binary, removed array<int>")


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    def finish(text, spans):
        return (len((text or "").encode()), sum(hi - lo for lo, hi in spans), len(spans),
                hashlib.sha256(kept_bytes(text, spans)).hexdigest())
    return repeated(docs, Bytes(window), "anywhere", finish,
                    "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
