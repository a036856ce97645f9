"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is encoded alone. Bytes
are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds
the longest token at a byte of the piece. The encoder takes that one and
backtracks to shorter ones, each the longest token that begins the one before. A
step is allowed only if the new token and the one before it would come out of the
merges as exactly that pair (memoised): the merges of both are undone, latest
first, and no merge across their border may come before the next one undone. A
prefix has one valid encoding, so a position found to have no way on is never
tried again and the search is linear in the piece. Beside the piece the search
holds its path and the positions it gave up.

Defined results: NULL text is treated as empty and gives no ids; equal rows
give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Memo, id_text, in_python

#: Entries kept in each worker's memos before they are emptied.
PIECE_MEMO = 300_000
PAIR_MEMO = 600_000
#: Texts above this many characters are cut piece by piece instead of as a list.
LONG_TEXT = 4_000_000
FLUSH_IDS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    """Encoder and decoder for one vocabulary of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.trie = ahocorasick.Automaton()
        for token in ranks:
            self.trie.add_word(token.decode("latin-1"), True)
        self.trie.make_automaton()
        self.longest = max(map(len, ranks), default=0)
        self.size_of = {i: len(t) for t, i in ranks.items()}
        #: By a text that begins a token: the longest token that begins the text.
        self.begins: dict[str, int] = {}
        for token in sorted(ranks, key=len):
            text = token.decode("latin-1")
            for size in range(1, len(text)):
                self.begins.setdefault(text[:size], self.begins.get(text[:size - 1], -1))
            self.begins[text] = ranks[token]
        self.shorter: dict[int, int] = {}
        self.edges: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = Memo(lambda piece: self.encode_piece(piece.encode()), PIECE_MEMO)

    def merges(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Merging by definition: the lowest-ranked adjacent pair first, up to
        a rank."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def next_shorter(self, token: int) -> int:
        """The longest token that begins ``token`` and is shorter; -1 for none."""
        found = self.shorter.get(token)
        if found is None:
            found = self.begins.get(self.bytes_of[token][:-1].decode("latin-1"), -1)
            self.shorter[token] = found
        return found

    def edge(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens that stand at the left and at the right end of ``token`` while
        it is merged, last first; None if the merges never make it."""
        if token in self.edges:
            return self.edges[token]
        data = self.bytes_of[token]
        found: tuple | None = ((token,), (token,))
        if len(data) > 1:
            parts = self.merges(data, token)
            ends = [self.edge(p) for p in parts]
            found = None if len(parts) != 2 or None in ends else (
                (token, *ends[0][0]), (token, *ends[1][1]))
        self.edges[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is what the merges make of their bytes."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        ends, begins = self.edge(left), self.edge(right)
        if ends is None or begins is None:
            return self.merges(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        a, b = ends[1], begins[0]
        i = j = 0
        before = 1 << 60  # a merge across the border below this rank would have come first
        while True:
            across = self.ranks.get(self.bytes_of[a[i]] + self.bytes_of[b[j]])
            if across is not None and across < before:
                return False
            # single bytes are there from the start; of equal merges the left one comes first
            made_a = a[i] if i + 1 < len(a) else -1
            made_b = b[j] if j + 1 < len(b) else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, i = made_a, i + 1
            else:
                before, j = made_b + 1, j + 1

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        text, n, span = data.decode("latin-1"), len(data), self.longest
        begins, reach, size_of = self.begins, self.trie.longest_prefix, self.size_of
        known, shorter = self.pairs.get, self.shorter.get
        dead: set[int] = set()
        path: list[int] = []
        at, last = 0, -1
        token = begins.get(text[:reach(text[:span])], -1)
        while True:
            while token >= 0:
                end = at + size_of[token]
                if end not in dead:
                    if last < 0:
                        break
                    fit = known(last << 32 | token)
                    if fit or fit is None and self.fits(last, token):
                        break
                found = shorter(token)
                token = self.next_shorter(token) if found is None else found
            if token >= 0:
                path.append(token)
                if end == n:
                    return tuple(path)
                at, last = end, token
                token = begins.get(text[at:at + reach(text[at:at + span])], -1)
            elif path:
                dead.add(at)
                token = path.pop()
                at -= size_of[token]
                last = path[-1] if path else -1
                token = self.next_shorter(token)
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            pieces = (m.group() for m in self.pattern.finditer(text))
        else:
            pieces = self.pattern.findall(text)
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, pieces)), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(load_ranks(path), pattern)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary (the ids turned back into bytes).

    ``path`` is the rank file, readable on every executor; it is a file of the
    installed tokenizer package, not data of the job."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            keys, sizes, ids, decoded, held = [], [0], [], [], 0
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    got = c.encode(text or "")
                    keys.append(key)
                    ids.append(got)
                    decoded.append(c.decode(got.tolist()))
                    held += len(got)
                    sizes.append(held)
                    if held >= FLUSH_IDS:
                        yield pack(keys, sizes, ids, decoded)
                        keys, sizes, ids, decoded, held = [], [0], [], [], 0
            if keys:
                yield pack(keys, sizes, ids, decoded)

    def pack(keys, sizes, ids, decoded):
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()),
                                         pa.array(np.concatenate(ids), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), lists, pa.array(decoded, pa.binary())],
            names=["doc_id", "ids", "decoded"])

    return in_python(id_text(docs), run, "doc_id long, ids array<int>, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of an encoded table."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
