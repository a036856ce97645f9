"""Passages repeated in a corpus: the frame shared by the two substring operators.

The text is a row of units (bytes or words). A passage counts as repeated if a
window of ``spec.window`` units is found again. Windows are compared without
listing them all:

1. every window picks the leftmost smallest hash among its grams (winnowing);
   consecutive windows with the same pick form a run. Equal windows pick equal
   grams, so only runs with equal grams can hold equal windows;
2. grams seen once in the corpus are left behind; texts that hold a repeated
   one are written to a table with their runs, the rest are finished;
3. runs with equal gram and equal content form a class. A run of a class with
   several members needs no further look; if only earlier documents count, that
   holds behind the class's first document, and its other runs of the class are
   *twins* of the one that stands for the class;
4. among different classes of one gram, ``spec.compare`` finds the equal
   windows, one member per class, up to ``LIMIT`` classes at a time. Twins get
   the same spans, shifted to their place;
5. grams with more classes are split: their runs are cut into shorter pieces
   keyed by the content that all windows of a piece share, and go through 3 and
   4 again, twins included, down to single windows. No group is ever gathered
   whole. Each split keeps the texts of the runs it cuts, and what follows reads
   those only.

Only hashes, row keys and offsets shuffle, besides the texts themselves: at most
four times, however often groups are split, but for the texts of the split runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualmark.session import discard

from .base import id_text, in_python, map_rows, step

#: Classes of one key that are compared in one go.
LIMIT = 256

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    return (x ^ (x >> np.uint64(27))) * _C


def leftmost_minima(grams: np.ndarray, span: int) -> np.ndarray:
    """For every window of ``span`` grams the place of its leftmost minimum.
    Windows cross one block border at most, so a minimum is that of a block's
    tail or of the next block's head; low bits hold the place within the two."""
    n = len(grams)
    bits = (2 * span).bit_length()
    low = np.uint64((1 << bits) - 1)
    blocks = -(-n // span)
    top = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    top[:n] = grams
    top = (top & ~low).reshape(blocks, span)
    place = np.arange(span, dtype=np.uint64)
    tail = np.minimum.accumulate((top | place)[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(top | (place + np.uint64(span)), axis=1).ravel()
    p = np.arange(n - span + 1)
    least = np.where(p % span == 0, tail[p], np.minimum(tail[p], head[p + span - 1]))
    return p - p % span + (least & low).astype(np.int64)


def runs(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and picked gram of every run."""
    at = leftmost_minima(grams, span)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return first, np.diff(first, append=len(at)), at[first]


#: Multiplier of the range hashes and its inverse modulo 2 ** 64.
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 14, 2 * n)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]))
                      for x in (np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


class Ranges:
    """Hashes of many ranges of a row of values, from one running sum."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _powers(len(values) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1])])

    def __call__(self, lo: np.ndarray, hi: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        raw = (self.sums[hi] - self.sums[lo]) * self.down[lo]
        more = (hi - lo).astype(np.uint64) + np.asarray(salt, np.int64).astype(np.uint64) * _C
        return mix(raw + more * _A).view(np.int64)


class Spec:
    """What a unit is. ``units`` reads a text; ``values`` gives a mixed 64-bit
    hash of every ``wide`` units; ``grams`` one of every ``gram`` units; ``cut``
    the bytes of a range; ``compare`` the equal windows of a group of members
    (doc_id, text_id, first unit, lead, windows, bytes) as (member, from, to)."""

    window: int
    gram: int
    wide: int
    #: Windows per piece at each step of splitting; the last is 1.
    pieces: tuple[int, ...]

    def units(self, text: str): ...
    def values(self, units) -> np.ndarray: ...
    def grams(self, units, values: np.ndarray) -> np.ndarray: ...
    def cut(self, units, lo: int, hi: int) -> bytes: ...
    def compare(self, members: list, mode: str) -> Iterable[tuple[int, int, int]]: ...


def _text_id(text: str) -> int:
    """Tells texts of one doc_id apart."""
    return xxhash.xxh32_intdigest(text.encode()) >> 1


def _runs_of(spec: Spec, text: str | None):
    """The values, and first window, windows, picked place and key of each run."""
    units = spec.units(text or "")
    if len(units) < spec.window:
        return None
    values = spec.values(units)
    grams = spec.grams(units, values)
    first, count, at = runs(grams, spec.window - spec.gram + 1)
    return values, first, count, at, (grams[at] >> np.uint64(16)).astype(np.int64)


def _emit(df: DataFrame, make: Callable[[], Callable[..., list[np.ndarray] | None]],
          schema: list[tuple[str, pa.DataType]], spark_schema: str) -> DataFrame:
    """Flat map from a row to arrays of equal length, one per output column."""
    def run(batches):
        fn = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                got = [x for x in map(fn, *(c.to_pylist() for c in part.columns)) if x is not None]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), t) for c, (_, t) in zip(zip(*got), schema)],
                        names=[n for n, _ in schema])
    return in_python(df, run, spark_schema)


def _seeds(docs: DataFrame, spec: Spec, times: bool) -> DataFrame:
    """Picked grams of each document, and with ``times`` how often they were picked."""
    def make():
        def one(doc_id, text):
            got = _runs_of(spec, text)
            if got is None:
                return None
            if not times:
                key = np.unique(got[4])
                return [key, np.full(len(key), doc_id)]
            key, n = np.unique(got[4], return_counts=True)
            return [key, np.full(len(key), doc_id), n]
        return one
    columns = [("key", pa.int64()), ("doc_id", pa.int64())] + ([("n", pa.int32())] if times else [])
    return _emit(docs, make, columns, "key long, doc_id long" + (", n int" if times else ""))


_ROW = [("key", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int32()),
        ("at", pa.int32()), ("w", pa.int32()), ("lead", pa.int32())]
_SPARK_ROW = "key long, content long, doc_id long, text_id int, at int, w int, lead int"


def _shared_runs(spec: Spec, doc_text: str, shared: list[int]) -> list[list[int]]:
    """key, content, at, w and lead of the runs of a text's repeated grams."""
    values, *got = _runs_of(spec, doc_text)
    wanted = np.isin(got[3], np.array(shared, np.int64))
    first, count, at, key = (x[wanted] for x in got)
    content = Ranges(values)(first, first + count + spec.window - spec.wide)
    return [x.tolist() for x in (key, content, first, count, at - first)]


def split(at: np.ndarray, w: np.ndarray, lead: np.ndarray, size: int):
    """Pieces of at most ``size`` windows, aligned on the picked gram: the run of
    each, its number, the first unit that all windows of a whole piece share,
    and its first and last window."""
    low, high = (lead - w + 1) // size, lead // size
    n = high - low + 1
    run = np.repeat(np.arange(len(at)), n)
    q = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    core = lead[run] - size * q
    return run, q, core, np.maximum(0, core - size + 1), np.minimum(w[run] - 1, core)


def _split_rows(members: DataFrame, spec: Spec, size: int) -> DataFrame:
    """Pieces of runs, keyed by the units that all windows of a whole piece share."""
    def make():
        def one(doc_id, text_id, text, runs_):
            at, w, lead = (np.array([r[k] for r in runs_], np.int64) for k in ("at", "w", "lead"))
            run, q, core, lo, hi = split(at, w, lead, size)
            ranges, start = Ranges(spec.values(spec.units(text))), at[run]
            end = spec.window - spec.wide + 1
            key = ranges(start + core, start + core - size + end, q + 1)
            content = ranges(start + lo, start + hi + end)
            rows = np.unique(np.stack([key, content, start + lo, hi - lo + 1, lead[run] - lo]), axis=1)
            same = np.full(rows.shape[1], 1)
            return [rows[0], rows[1], same * doc_id, same * text_id, *rows[2:]]
        return one
    return _emit(members, make, _ROW, _SPARK_ROW)


def _classes(rows: DataFrame, mode: str) -> DataFrame:
    """Classes with their size and first member. Which run of the first document
    it is matters in mode "earlier" only; elsewhere any will do (in mode "earlier
    document" the others are its twins), which keeps the aggregate in fixed-width
    hash buffers."""
    spot = rows.withColumn("spot", F.shiftleft(F.col("text_id").cast("long"), 32) + F.col("at"))
    first = (F.min(F.struct("doc_id", "spot")) if mode == "earlier" else
             F.struct(F.min("doc_id").alias("doc_id"), F.min_by("spot", "doc_id").alias("spot")))
    return (spot.groupBy("key", "content")
            .agg(first.alias("f"), F.count("*").alias("n"), F.min("w").alias("w"), F.min("lead").alias("lead"))
            .select("key", "content", F.struct(
                F.col("f.doc_id"), F.shiftright("f.spot", 32).cast("int").alias("text_id"),
                F.col("f.spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at")).alias("first"),
                "n", "w", "lead"))


def _settled(rows: DataFrame, classes: DataFrame, spec: Spec, mode: str) -> DataFrame:
    """Spans of the runs whose whole content has a counterpart that counts. In
    mode "earlier document" also the twins, told by a filled ``twin``."""
    several = classes.filter("n > 1").select("key", "content", "first")
    own, more = F.lit(True), []
    if mode == "earlier document":
        other = F.struct("text_id", "at") != F.struct("first.text_id", "first.at")
        own = (F.col("doc_id") > F.col("first.doc_id")) | ((F.col("doc_id") == F.col("first.doc_id")) & other)
        more = [F.when(F.col("doc_id") == F.col("first.doc_id"), F.struct(
            "key", "w", "lead", F.col("first.text_id").alias("text_id"), F.col("first.at").alias("at"))).alias("twin")]
    elif mode == "earlier":
        own = F.struct("doc_id", "text_id", "at") != F.col("first")
    return (rows.join(several, ["key", "content"]).filter(own)
            .select("doc_id", "text_id", F.col("at").alias("lo"),
                    (F.col("at") + F.col("w") + spec.window - 1).alias("hi"), *more))


def _twins(settled: DataFrame) -> DataFrame:
    """The twins with the place (text_id, at) of the run that stands for them."""
    return settled.filter("twin is not null").select(
        "doc_id", F.col("text_id").alias("twin_text"), F.col("lo").alias("twin_at"), "twin.*")


def _shifted(found: DataFrame, twins: DataFrame) -> DataFrame:
    """The spans found in a run, at the places of its twins."""
    shift = F.col("twin_at") - F.col("at")
    return (found.join(twins, ["doc_id", "text_id", "at"])
            .select("doc_id", F.col("twin_text").alias("text_id"), (F.col("lo") + shift).alias("lo"),
                    (F.col("hi") + shift).alias("hi")))


def _with_twins(large: DataFrame, twins: DataFrame) -> DataFrame:
    """The classes' runs that are to be split, and their twins."""
    runs_ = large.select("key", "first", "w", "lead")
    place = runs_.select("first.doc_id", "first.text_id", "first.at")
    return runs_.unionByName(
        twins.join(place, ["doc_id", "text_id", "at"], "left_semi")
        .select("key", F.struct("doc_id", F.col("twin_text").alias("text_id"), F.col("twin_at").alias("at"))
                .alias("first"), "w", "lead"))


def _with_text(classes: DataFrame, kept: DataFrame) -> DataFrame:
    """Each text with the class members that are to be read from it."""
    by_text = (classes.select("first.doc_id", "first.text_id",
                              F.struct("key", F.col("first.at").alias("at"), "w", "lead").alias("r"))
               .groupBy("doc_id", "text_id").agg(F.collect_list("r").alias("runs")))
    once = kept.select("doc_id", "text_id", "text").dropDuplicates(["doc_id", "text_id"])
    return once.join(by_text, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "runs")


def _holding(classes: DataFrame, kept: DataFrame) -> DataFrame:
    """The texts that hold a class member; where these are few, the others do not move."""
    place = classes.select("first.doc_id", "first.text_id").distinct()
    return kept.join(place, ["doc_id", "text_id"], "left_semi")


def _compared(classes: DataFrame, kept: DataFrame, spec: Spec, mode: str) -> DataFrame:
    """Spans by comparing the members of each key, with the place of their run."""
    def read():
        def one(doc_id, text_id, text, runs_):
            units = spec.units(text)
            for r in runs_:
                lo = r["at"]
                yield (r["key"], doc_id, text_id, lo, r["lead"], r["w"],
                       spec.cut(units, lo, lo + r["w"] + spec.window - 1))
        return one

    def make():
        def one(members):
            members = sorted((tuple(m.values()) for m in members), key=lambda m: m[:3])
            found: dict[int, list[tuple[int, int]]] = {}
            for i, lo, hi in spec.compare(members, mode):
                found.setdefault(i, []).append((lo, hi))
            for i, spans in found.items():
                doc_id, text_id, at = members[i][:3]
                for lo, hi in merge(spans):
                    yield doc_id, text_id, at, at + lo, at + hi
        return one

    data = map_rows(_with_text(classes, kept), read,
                    "key long, doc_id long, text_id int, at int, lead int, w int, data binary")
    groups = data.groupBy("key").agg(F.collect_list(F.struct(
        "doc_id", "text_id", "at", "lead", "w", "data")).alias("members"))
    return map_rows(groups.select("members"), make, "doc_id long, text_id int, at int, lo int, hi int")


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def repeated(docs: DataFrame, spec: Spec, mode: str,
             finish: Callable[[str | None, list[tuple[int, int]]], tuple], schema: str) -> DataFrame:
    """One row per document: doc_id and ``finish(text, spans)`` with ``schema``.
    Spans are the merged unit ranges covered by repeated windows, where a
    counterpart counts if it is ``mode``: "anywhere" else, "earlier" in order of
    doc_id and place, or in an "earlier document"."""
    base = id_text(docs)
    known = base.filter("doc_id is not null and text is not null")
    times = mode != "earlier document"  # else only other documents count
    many = F.sum("n") > 1 if times else F.count("*") > 1
    seeds = step(_seeds(known, spec, times), "seeds")
    twice = seeds.groupBy("key").agg(many.alias("again")).filter("again").select("key")
    hits = step(seeds.select("key", "doc_id").join(twice.hint("shuffle_hash"), "key", "left_semi")
                .groupBy("doc_id").agg(F.collect_list("key").alias("shared")), "hits")
    discard(seeds)
    names = (schema + ", doc_id long, text_id int, whole string, "
             "key array<long>, content array<long>, at array<int>, w array<int>, lead array<int>")
    width = len(map_fields(schema))

    def sort_out():
        def one(doc_id, text, shared):
            if shared is None:
                yield *finish(text, []), doc_id, *[None] * 7
            else:
                yield *[None] * width, doc_id, _text_id(text), text, *_shared_runs(spec, text, shared)
        return one

    table = step(map_rows(base.join(hits, "doc_id", "left").select("doc_id", "text", "shared"),
                          sort_out, names), "texts")
    discard(hits)
    kept = table.filter("whole is not null").select("doc_id", "text_id", F.col("whole").alias("text"))
    rows = (table.select("doc_id", "text_id", F.explode(F.arrays_zip("key", "content", "at", "w", "lead")).alias("r"))
            .select("doc_id", "text_id", "r.*"))
    spans, texts = [], kept
    for size in (*spec.pieces, 0):
        classes = step(_classes(rows, mode), "classes")
        settled = step(_settled(rows, classes, spec, mode), "settled")
        discard(rows)
        spans.append(settled if times else settled.filter("twin is null").drop("twin"))
        if not size:  # pieces of one window: a key has one class
            break
        twins = None if times else step(_twins(settled), "twins")
        mixed = classes.groupBy("key").agg(F.count("*").alias("k"), F.min("first.doc_id").alias("lo"),
                                           F.max("first.doc_id").alias("hi")).filter("k > 1")
        if mode == "earlier document":
            mixed = mixed.filter("lo < hi")
        several = classes.join(mixed.select("key", "k"), "key")
        compared = step(_compared(several.filter(F.col("k") <= LIMIT), texts, spec, mode), "compared")
        spans.append(compared.drop("at"))
        if twins is not None:
            spans.append(_shifted(compared, twins))
        large = step(several.filter(F.col("k") > LIMIT), "large")
        discard(classes)
        if large.isEmpty():
            break
        runs_ = large if twins is None else _with_twins(large, twins)
        cut = step(_with_text(runs_, _holding(runs_, texts)), "cut")
        discard(large)
        discard(texts)
        texts = cut
        rows = step(_split_rows(texts, spec, size), "rows")
    discard(texts)
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    by_text = found.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def end():
        def one(doc_id, text, got):
            yield doc_id, *finish(text, merge((s["lo"], s["hi"]) for s in got or ()))
        return one

    fields = map_fields(schema)
    done = table.filter("whole is null").select("doc_id", *fields)
    rest = map_rows(kept.join(by_text, ["doc_id", "text_id"], "left").select("doc_id", "text", "spans"),
                    end, "doc_id long, " + schema)
    return done.unionByName(rest)


def map_fields(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string
    return _parse_datatype_string(schema).fieldNames()
