"""Vector code compression: product quantisation, entries found by Orchard's search.

Vectors become integers floor(1024 * x) and are cut into ``PARTS`` equal parts. A
part position's codebook starts as that part of the 256 smallest vec_ids; each
round assigns every part to its nearest entry and moves entries to the floor of
their parts' mean. Nearest entries come from *Orchard's search*: every entry has
a list of all entries sorted by distance; the walk follows the list of the best
entry so far, jumps to the list of any entry that is nearer, marks what it has
measured, and stops where the list's distance exceeds twice the current one (by
the triangle inequality nothing behind can be nearer). Equal distances go to the
lower index. A batch of vectors walks in lock step, as numpy arrays.

Each round is one pass over the integer vectors; a task returns one row of sums
per entry it met, so the shuffle and the driver see codebooks only, never vectors.
A codebook is at most 256 x dimension integers.

Defined results: rows whose vector is NULL, empty, holds NULL or non-finite
components, or has another length than the most common one (ties: the shorter)
are dropped. Lengths that 4 does not divide are filled up with zeros. A repeated
vec_id starts one entry only (its lexicographically smallest vector); a row
without vec_id is encoded but starts none; every kept row gives a row. With fewer
than 256 vec_ids the codebook is smaller; without any (or an empty table) the
result is empty. Integers beyond ``limit_of(width)`` (components of 131,072 and
more at 16 a part) are clamped, so that distances fit 64 bits. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import in_python, materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0
#: Vectors that walk in lock step.
BLOCK = 4096

CODED = "vec_id long, label int, code string, error long"


def limit_of(width: int) -> int:
    """The largest component for which four times a squared distance fits 62 bits."""
    return int((2 ** 58 / max(width, 1)) ** 0.5)


@dataclass
class Book:
    """One part position's entries with every entry's sorted neighbour list."""

    entries: np.ndarray  # (k, width)

    def __post_init__(self) -> None:
        e = self.entries
        d = np.zeros((len(e), len(e)), np.int64)
        for i, row in enumerate(e):
            d[i] = ((e - row) ** 2).sum(1)
        self.order = np.argsort(d, axis=1, kind="stable").astype(np.int32)
        self.far = np.take_along_axis(d, self.order.astype(np.int64), 1)
        self.by_sum = np.argsort(e.sum(1), kind="stable")
        self.sums = e.sum(1)[self.by_sum]

    def start(self, x: np.ndarray) -> np.ndarray:
        """A first entry for each vector: one with a close sum of components."""
        at = np.searchsorted(self.sums, x.sum(1)).clip(0, len(self.sums) - 1)
        return self.by_sum[at]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each vector's nearest entry, and the
        number of distances measured."""
        index, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        measured = 0
        for lo in range(0, len(x), BLOCK):
            index[lo:lo + BLOCK], dist[lo:lo + BLOCK], n = self._walk(x[lo:lo + BLOCK])
            measured += n
        return index, dist, measured

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        k = len(self.entries)
        at = self.start(x)
        best = ((x - self.entries[at]) ** 2).sum(1)
        marked = np.zeros((len(x), k), bool)
        marked[np.arange(len(x)), at] = True
        step = np.zeros(len(x), np.int64)
        walking = np.arange(len(x))
        measured = len(x)
        while len(walking):
            entry, place = at[walking], step[walking]
            walking = walking[self.far[entry, place] <= 4 * best[walking]]
            to = self.order[at[walking], step[walking]]
            step[walking] += 1
            new = ~marked[walking, to]
            who, to = walking[new], to[new]
            if len(who):
                marked[who, to] = True
                d = ((x[who] - self.entries[to]) ** 2).sum(1)
                measured += len(who)
                better = (d < best[who]) | ((d == best[who]) & (to < at[who]))
                who, to = who[better], to[better]
                at[who], best[who], step[who] = to, d[better], 0
            walking = walking[step[walking] < k]
        return at, best, measured


def finite(name: str) -> Column:
    """Whether all components are there and finite."""
    return F.forall(F.col(name), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def integers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The kept rows (vec_id, label, ints) and the length of a part."""
    v = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                          v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite("v"))
    common = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 0
    width = -(-dim // PARTS)
    top = float(limit_of(width))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x * SCALE, F.lit(top)), F.lit(-top))).cast("long")

    ints = F.concat(F.transform("v", whole), F.array_repeat(F.lit(0).cast("long"), width * PARTS - dim))
    return kept.filter(F.size("v") == dim).select("vec_id", "label", ints.alias("ints")), width


def first_books(ints: DataFrame, width: int, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks to start with: at most ``entries`` rows come to the driver."""
    ids = ints.select("vec_id").filter(F.col("vec_id").isNotNull()).distinct().orderBy("vec_id").limit(entries)
    rows = (ints.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("ints").alias("ints"))
            .orderBy("vec_id").collect())
    table = np.array([r["ints"] for r in rows], np.int64).reshape(len(rows), PARTS, width)
    return [table[:, p] for p in range(PARTS)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), PARTS, width)


def sums(ints: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, pos, total) of all parts assigned to an entry; pos -1 counts them."""
    kind = "part int, entry int, pos int, total long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Book(b) for b in books]
        total = np.zeros((PARTS, len(books[0]), width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for p, book in enumerate(made):
                at, _, _ = book.nearest(x[:, p])
                np.add.at(total[p], (at, slice(1, None)), x[:, p])
                total[p, :, 0] += np.bincount(at, minlength=len(total[p]))
        part, entry = np.nonzero(total[:, :, 0])
        found = total[part, entry]
        n = width + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, n).astype(np.int32)), pa.array(np.repeat(entry, n).astype(np.int32)),
             pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(part))), pa.array(found.reshape(-1))],
            names=["part", "entry", "pos", "total"])

    return (in_python(ints.select("ints"), run, kind).groupBy("part", "entry", "pos")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))


def moved(ints: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round; an entry without parts stays."""
    table = {(r["part"], r["entry"], r["pos"]): int(r["total"]) for r in sums(ints, books, width).collect()}
    out = [b.copy() for b in books]
    for (p, e, pos), n in table.items():
        if pos == -1:
            for i in range(width):
                out[p][e, i] = table[p, e, i] // n
    return out


def encode(ints: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Book(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column(2), width)
            found = [book.nearest(x[:, p]) for p, book in enumerate(made)]
            code = np.stack([f[0] for f in found], 1).astype(np.uint8)
            text = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(sum(f[1] for f in found))],
                names=["vec_id", "label", "code", "error"])

    return in_python(ints.select("vec_id", "label", "ints"), run, CODED)


def train(ints: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    books = first_books(ints, width, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = moved(ints, books, width)
    return books


def decode(coded: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(vec_id, approx) of every row: the vector that its code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, PARTS)
            x = np.concatenate([b[code[:, p]] for p, b in enumerate(books)], 1)[:, :dim] / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["vec_id", "approx"])

    return in_python(coded.select("vec_id", "code"), run, "vec_id long, approx array<double>")


def books_sha(books: list[np.ndarray]) -> str:
    flat = ",".join(str(v) for b in books for v in b.reshape(-1).tolist())
    return hashlib.sha256(flat.encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    rows, width = integers(vectors)
    ints = materialize(rows, "vector-ints")
    books = train(ints, width)
    coded = materialize(encode(ints, books, width) if len(books[0]) else
                        ints.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
                        .limit(0), "vector-codes")
    by = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha(books)).alias("codebooks_sha256"))
