"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (a
shorter item is one window). Containment of a window's shingles must be total,
so its prefix is one shingle: the rarest of its shingles, by counts over all
documents. Documents are joined with those prefix shingles only. The matched
position fixes where the window must begin; it is kept if the window lies
inside the document (position and length bounds) and its words are equal there.

The benchmark is handled in blocks of at most ``block_words`` words, so what a
task holds is bounded; every block meets every document. A longer item is cut
into parts that share ``WINDOW`` - 1 words, all under its id, so no window is
lost. Documents never shuffle.

Defined results: NULL text has no words and no hits. Items with NULL id or
without words have no windows. Repeated items share windows and are all listed.
Each input row gives one output row, also when a doc_id is NULL or repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_text, in_python, map_batches, map_rows, materialize

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 1_000_000

#: ASCII letters and digits stay (lower-cased), other ASCII separates words;
#: bytes of non-ASCII characters are word characters.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Block:
    """Windows of some items: the word numbering, and once the corpus counts
    are known, the prefix index."""

    BITS = 21

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), set()).add(item)
        if len(self.number) >= 1 << self.BITS:
            raise ValueError("a block has too many different words")
        self.windows = [np.array(w, np.int64) for w in owners]
        self.owners = [sorted(o) for o in owners.values()]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.vocabulary = {s: np.unique(np.concatenate(
            [self.shingles(w, s) for w in self.windows if min(SHINGLE, len(w)) == s]))
            for s in self.sizes}
        self.keys: dict[int, np.ndarray] = {}
        self.entries: dict[int, list[list[tuple[int, int]]]] = {}

    def shingles(self, ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code = ids[:n].copy()
        for j in range(1, size):
            code = (code << self.BITS) | ids[j:j + n]
        return code

    def ids(self, ws: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in ws], np.int64)

    def seen(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Places of the document's shingles in the block's vocabulary, -1 if absent."""
        code, known = self.shingles(ids, size), self.vocabulary[size]
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where(known[at] == code, at, -1)

    def index(self, counts: dict[tuple[int, int], int]) -> None:
        """Put every window under its rarest shingle, with that shingle's offset."""
        for s in self.sizes:
            under: dict[int, list[tuple[int, int]]] = {}
            for w, ids in enumerate(self.windows):
                if min(SHINGLE, len(ids)) == s:
                    places = np.searchsorted(self.vocabulary[s], self.shingles(ids, s))
                    rare = min(range(len(places)),
                               key=lambda o: (counts.get((s, int(places[o])), 0), int(places[o])))
                    under.setdefault(int(places[rare]), []).append((w, rare))
            self.keys[s] = np.zeros(len(self.vocabulary[s]), bool)
            self.keys[s][list(under)] = True
            self.entries[s] = [under.get(i, []) for i in range(len(self.keys[s]))]

    def find(self, ws: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Mask of the words inside any occurrence, and the items that occur."""
        ids, hit, found = self.ids(ws), np.zeros(len(ws), bool), set()
        for s in self.sizes:
            at = self.seen(ids, s)
            for j in np.flatnonzero((at >= 0) & self.keys[s][at]):
                for w, offset in self.entries[s][at[j]]:
                    window, start = self.windows[w], j - offset
                    if start >= 0 and start + len(window) <= len(ids) and np.array_equal(
                            ids[start:start + len(window)], window):
                        hit[start:start + len(window)] = True
                        found.update(self.owners[w])
        return hit, found


def _count(docs: DataFrame, block) -> dict[tuple[int, int], int]:
    """Occurrences of the block's shingles over all documents; each task sends
    at most one row per shingle."""
    def run(batches):
        import pyarrow as pa
        b = block.value
        total = {s: np.zeros(len(b.vocabulary[s]), np.int64) for s in b.sizes}
        for batch in batches:
            for text in batch.column(1):
                ids = b.ids(words(text.as_py()))
                for s in b.sizes:
                    at = b.seen(ids, s)
                    np.add.at(total[s], at[at >= 0], 1)
        for s in b.sizes:
            at = np.flatnonzero(total[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), s)), pa.array(at), pa.array(total[s][at])],
                names=["s", "at", "n"])

    rows = (in_python(docs, run, "s long, at long, n long")
            .groupBy("s", "at").agg(F.sum("n").alias("n")))
    return {(r.s, r.at): r.n for r in rows.toLocalIterator()}


def _parts(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """Items with more than ``block_words`` words as overlapping parts."""
    size, shared = max(block_words, window), window - 1

    def make():
        def one(item_id, text):
            ws = words(text)
            if len(ws) <= size:
                yield item_id, 0, text
                return
            for i, lo in enumerate(range(0, len(ws) - shared, size - shared)):
                yield item_id, i, b" ".join(ws[lo:lo + size]).decode()
        return one

    return map_rows(items, make, "item_id long, part int, text string")


def _blocks(items: DataFrame, block_words: int):
    """Items in blocks of bounded size; one block is on the driver at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():
        n = len(words(row.text))
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += n
    if held:
        yield held


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (disjoint word intervals as start and end in
    turn) and items (ids of the benchmark items with occurring windows)."""
    state = id_text(docs).withColumns({"spans": F.array().cast("array<int>"),
                                       "items": F.array().cast("array<long>")})
    return _each_block(docs, benchmark, window, block_words, state,
                       lambda s, block, last: _scan(s, block, keep_text=not last))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Every row
    is judged by its own text, also when its doc_id is NULL or repeated."""
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    return _each_block(docs, benchmark, window, block_words,
                       docs.withColumn(spans, F.array().cast("array<int>")),
                       lambda s, block, last: _judge(s, block, spans, last)).select(docs.columns)


def _judge(state: DataFrame, block: Block, spans: str, last: bool) -> DataFrame:
    """Add the block's hits to the column ``spans`` of whole rows; the last block
    leaves the clean rows."""
    shared = state.sparkSession.sparkContext.broadcast(block)
    at, text = state.columns.index(spans), state.columns.index("text")

    def make():
        b = shared.value

        def judged(batch):
            out, clean = [], []
            for t, old in zip(batch.column(text), batch.column(at)):
                hit = _hits(b, words(t.as_py()), old.as_py())[0]
                out.append(np.flatnonzero(np.diff(hit, prepend=False, append=False)).tolist())
                clean.append(not (hit.any() and 20 * int(hit.sum()) >= len(hit)))
            if last:
                return batch.filter(pa.array(clean, pa.bool_()))
            field = batch.schema.field(at)
            return batch.set_column(at, field, pa.array(out, field.type))
        return judged

    return map_batches(state, make)


def _hits(block: Block, ws: list[bytes], spans: list[int]) -> tuple[np.ndarray, set[int]]:
    """Words inside earlier spans or an occurrence, and the items that occur."""
    hit, found = block.find(ws)
    for lo, hi in zip(spans[::2], spans[1::2]):
        hit[lo:hi] = True
    return hit, found


def _each_block(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, state: DataFrame,
                scan) -> DataFrame:
    """``scan(state, block, last)`` for every block of the benchmark in turn."""
    spark = docs.sparkSession
    base = id_text(docs)
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                              F.col("text").cast("string").alias("text"))
             .filter("item_id is not null and text is not null"))
    items = _parts(items, window, block_words).orderBy("item_id", "part")
    blocks = [Block([], window)]
    for held in _blocks(items, block_words):
        block = Block(held, window)
        if block.windows:
            if blocks[0].windows:  # more to come: this block's hits are kept as a table
                state = materialize(scan(state, blocks[0], False), "decontam")
            block.index(_count(base, spark.sparkContext.broadcast(block)))
            blocks[0] = block
    return scan(state, blocks[0], True)


def _scan(state: DataFrame, block: Block, keep_text: bool = False) -> DataFrame:
    """Add the block's hits to each document; the last scan puts the number of
    words in place of the text."""
    shared = state.sparkSession.sparkContext.broadcast(block)

    def make():
        b = shared.value

        def one(doc_id, text, spans, found):
            ws = words(text)
            hit, more = _hits(b, ws, spans)
            edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
            yield (doc_id, text if keep_text else len(ws), edges.tolist(),
                   sorted(more | set(found)))
        return one

    second = "text string" if keep_text else "n_words long"
    return map_rows(state, make, f"doc_id long, {second}, spans array<int>, items array<long>")


def digest(found: DataFrame) -> DataFrame:
    """The result columns of a table of ``find_benchmark``."""
    n_hit = F.expr("aggregate(sequence(0, size(spans) div 2 - 1), 0L, "
                   "(a, i) -> a + spans[2 * i + 1] - spans[2 * i])")
    out = found.withColumn("n_hit", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0)).cast("long"))
    names = F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
