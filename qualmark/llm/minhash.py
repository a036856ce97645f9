"""Near-duplicate detection by one-permutation MinHash.

A document's shingle set is hashed once; the hash range is cut into bins and
each bin keeps its minimum. Empty bins are filled by optimal densification:
every bin has its own random order of the others and borrows from the first
non-empty one. Bands of bins give buckets, and a bucket gives only a star of
candidate edges, so the pairs of a bucket are as many as its rows.

All links count, not only those with a centre, so stars are drawn in rounds
over what is still apart:

1. equal sets form one class; only class representatives go on;
2. each representative is compared with the most popular centre of its buckets
   (popularity: rows it shares buckets with; the hub of a copy group has most);
3. then with the other centres of its buckets that lie in other components;
4. in buckets that still hold several components, each row is compared with the
   row of another component whose signature agrees best; ``NEAREST`` such rounds
   draw together what chains of links connect;
5. what is still apart is compared without listing pairs: representatives are
   dealt into *places* (those with one best centre, in chunks), the buckets tell
   which places hold rows of different components with similar signatures, and
   two such places are compared as matrices of their sets' ``LOWEST`` smallest
   hashes. That is exact for sets of this size, and an upper bound for larger.

Steps 4 and 5 see at most two chunks of ``CHUNK`` rows in a task. Rows reach
Python in small Arrow batches, as a candidate pair carries two whole texts.

Every candidate pair is confirmed on the full sets. The only way to miss a link
is that no band agrees: under 1e-9 per pair by the choice of the band width.
Components are found by repeated contraction in DataFrames.

Defined results: a text that is NULL or has no words has an empty set and links
with nothing. Rows are judged one by one; a NULL doc_id takes part in nothing,
has component NULL and is kept. Repeated rows get equal results; rows that share
a doc_id but not the text are judged apart. Classes are numbered, and their
numbers are the nodes; the smallest doc_id of a component is taken at the end.
Ties between centres go to the smaller number, which no result depends on.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualmark.session import small_batches

from .base import Memo, id_text, map_rows, materialize, step

BINS = 200
CHUNK = 1024
LOWEST = 512
#: Rows of a comparison matrix that are judged in one go.
STRIP = 128
#: Rounds in which a row is compared with its nearest row of another component only.
NEAREST = 2
#: Six standard deviations of the share of equal bins at the threshold.
MARGIN = 6.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * 2 + 1


def band_rows(similarity: float, bins: int = BINS) -> int:
    """The widest band for which a pair at the threshold is missed with a
    probability under 1e-9."""
    r = 1
    while r < 8 and (1 - similarity ** (r + 1)) ** (bins // (r + 1)) < 1e-9:
        r += 1
    return r


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        ws = text.encode().translate(_LOWER).split() if text else []
        if not ws:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, ws), np.uint64, len(ws))
        k = min(self.size, len(h))
        n = len(h) - k + 1
        code = np.full(n, k, np.uint64)
        for j in range(k):
            code = _mix(code * _ODD[0] + h[j:j + n])
        return np.unique(code)


def _borrow_order(bins: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    return np.argsort(rng.random((bins, bins)), axis=1)


def signature(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One minimum per bin; bins are equal ranges of the hash, so the sorted
    hashes' first entry in each range is its minimum."""
    bins = len(order)
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    sig, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sig[at[first]] = hashes[first]
    full[at[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        sig[empty] = sig[order[empty, np.argmax(full[order[empty]], axis=1)]]
    return sig


def sketch(docs: DataFrame, shingle: int, rows: int, bins: int = BINS) -> DataFrame:
    """doc_id, text_key (tells texts of one doc_id apart), n_shingles, set_id,
    bands (one bucket key each) and the low byte of every bin."""

    def make():
        sets, order = Shingler(shingle), _borrow_order(bins)
        bands = bins // rows
        label = np.arange(bands, dtype=np.uint64)

        def one(doc_id, text, text_key):
            h = sets(text)
            if not len(h):
                yield doc_id, text_key, 0, None, None, None
                return
            sig = signature(h, order)
            key = label
            for column in sig[:bands * rows].reshape(bands, rows).T:
                key = _mix(key * _ODD[1] + column)
            yield (doc_id, text_key, len(h), xxhash.xxh3_128_digest(h.tobytes()),
                   key.view(np.int64).tolist(), _mix(sig).astype(np.uint8).tobytes())
        return one

    return map_rows(_keyed(docs), make, "doc_id long, text_key long, n_shingles long, set_id binary, "
                                        "bands array<long>, sig binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("text_key", F.xxhash64("text"))


def components(links: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest member) of links (a, b), continuing from an
    earlier table. Each round every node points to its smallest neighbour,
    pointers are followed twice, and the links are redrawn between the ends."""
    label = old
    if old is not None:
        links = _redraw(links, old)
    while True:
        links = materialize(
            links.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                          F.least("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            break
        to = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        to = materialize(_follow(to, to), "pointers")
        to = materialize(_follow(to, to), "pointers")
        if label is None:
            label = to
        else:
            moved = _follow(label, to)
            label = moved.unionByName(to.join(label.select("node"), "node", "left_anti"))
        label = materialize(label, "labels")
        links = _redraw(links, to)
    if label is None:
        label = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def _follow(label: DataFrame, to: DataFrame) -> DataFrame:
    step = to.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return (label.join(step, "component", "left")
            .select("node", F.coalesce("next", "component").alias("component")))


def _redraw(links: DataFrame, to: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        step = to.select(F.col("node").alias(end), F.col("component").alias("to"))
        links = links.join(step, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return links.select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough. Texts of b travel to
    their a, so a centre's many rows can be split over tasks."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def make():
        sets = Shingler(shingle)
        last: list = [None, None]

        def one(a, b, text_a, text_b):
            if last[0] != a:
                last[:] = [a, sets(text_a)]
            x, y = last[1], sets(text_b)
            common = len(x) + len(y) - len(np.union1d(x, y))
            if 100 * common >= percent * (len(x) + len(y) - common):
                yield a, b
        return one

    return map_rows(both.select("a", "b", "text_a", "text_b"), make, "a long, b long")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    ends = pairs
    for end in ("a", "b"):
        step = label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(step, end, "left")
    return ends.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _mixed(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """key, rep, component and number of chunks of the buckets that hold
    several components."""
    placed = (buckets.select("key", "rep")
              .join(label.withColumnRenamed("node", "rep"), "rep", "left")
              .select("key", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = (placed.groupBy("key")
             .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
             .filter("lo <> hi").select("key", F.ceil(F.col("size") / CHUNK).cast("int").alias("n")))
    return placed.join(mixed, "key")


def _blocks(mixed: DataFrame, about: DataFrame, *columns: str) -> DataFrame:
    """lo, hi and the members of two chunks of a bucket (or of one)."""
    rows = (mixed.join(about, "rep").withColumn("c", F.pmod(F.xxhash64("rep"), "n").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .withColumn("lo", F.least("c", "other")).withColumn("hi", F.greatest("c", "other")))
    member = F.struct("rep", "component", "n_shingles", "sig", "c", *columns)
    return rows.groupBy("key", "lo", "hi").agg(F.collect_list(member).alias("m")).select("lo", "hi", "m")


def _similar(members: list, percent: int):
    """For each member: the places of members of other components (in the other
    chunk, if there are two) whose size and signature allow a link, and how well
    the signatures agree."""
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / BINS) ** 0.5
    rep, comp, n, c = (np.array([m[k] for m in members], np.int64)
                       for k in ("rep", "component", "n_shingles", "c"))
    if len(rep) < 2 or (comp == comp[0]).all():
        return
    sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(len(rep), -1)
    two = (c != c[0]).any()
    for i in range(len(rep)):
        near = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if two:
            near &= c != c[i]
        at = np.flatnonzero(near)
        if len(at):
            agree = (sig[at] == sig[i]).mean(axis=1)
            yield i, at[agree >= least], agree[agree >= least]


def _nearest(blocks: DataFrame, percent: int) -> DataFrame:
    """Each member with the one of another component that agrees best."""
    def make():
        def one(lo, hi, members):
            for i, at, agree in _similar(members, percent):
                if len(at):
                    a, b = members[i]["rep"], members[at[np.argmax(agree)]]["rep"]
                    yield min(a, b), max(a, b)
        return one
    return map_rows(blocks, make, "a long, b long").distinct()


def _meetings(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs of places with similar members of different components."""
    def make():
        def one(lo, hi, members):
            place = np.array([m["place"] for m in members], np.int64)
            met = set()
            for i, at, _ in _similar(members, percent):
                met.update((min(place[i], p), max(place[i], p)) for p in np.unique(place[at]))
            for p, q in met:
                yield int(p), int(q)
        return one
    return map_rows(blocks, make, "p long, q long").distinct()


def common_counts(rows: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of arrays of distinct values. Values
    in many rows are multiplied as columns, the others counted pair by pair."""
    size = len(rows)
    out = np.zeros((size, size), np.float32)
    owner = np.repeat(np.arange(size), [len(r) for r in rows])
    value, at, count = np.unique(np.concatenate([*rows, np.empty(0, np.uint32)]),
                                 return_inverse=True, return_counts=True)
    owner = owner[np.argsort(at, kind="stable")]
    start = np.concatenate([[0], np.cumsum(count)])[:-1]
    for c in range(2, 16):
        first = start[count == c]
        for x in range(c):
            for y in range(x + 1, c):
                np.add.at(out, (owner[first + x], owner[first + y]), 1)
    out += out.T
    wide = np.flatnonzero(count >= 16)
    for lo in range(0, len(wide), 1024):
        part = wide[lo:lo + 1024]
        column = np.repeat(np.arange(len(part)), count[part])
        table = np.zeros((size, len(part)), np.float32)
        table[np.concatenate([owner[s:s + c] for s, c in zip(start[part], count[part])]), column] = 1
        out += table @ table.T
    return out


def _between(meetings: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within two places that can be links by
    their lowest hashes."""
    ends = meetings.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("place"))
    groups = ends.join(places, "place").groupBy("p", "q").agg(
        F.collect_list(F.struct("rep", "component", "n_shingles", "low")).alias("m"))

    def make():
        def one(members):
            rep, comp, n = (np.array([m[k] for m in members], np.int64) for k in ("rep", "component", "n_shingles"))
            common = common_counts([np.frombuffer(m["low"], np.uint32) for m in members])
            j = percent / 100
            for lo in range(0, len(rep), STRIP):
                part = slice(lo, lo + STRIP)
                m, c, r = n[part, None], comp[part, None], rep[part, None]
                # of whole sets a share of the union; else so many of the union's lowest, which are in both
                need = np.where(np.maximum(m, n) <= LOWEST, j / (1 + j) * (m + n) - 1,
                                LOWEST * j - MARGIN * (LOWEST * j * (1 - j)) ** 0.5)
                fit = (common[part] >= need) & (c != comp) & (r < rep)
                for a, b in zip(*np.nonzero(fit)):
                    yield int(rep[lo + a]), int(rep[b])
        return one
    return map_rows(groups.select("m"), make, "a long, b long").distinct()


def _rest(buckets: DataFrame, label: DataFrame, reps: DataFrame, best: DataFrame, texts: DataFrame,
          shingle: int, percent: int) -> DataFrame:
    """Candidate pairs among all that is still apart."""
    mixed = materialize(_mixed(buckets, label), "mixed")
    apart = mixed.select("rep", "component").distinct()
    home = apart.join(best.select(F.col("b").alias("rep"), "a"), "rep", "left").select(
        "rep", "component", F.coalesce("a", "rep").alias("home"))
    sizes = home.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    placed = home.join(sizes, "home").select(
        "rep", "component", F.xxhash64("home", F.pmod(F.xxhash64("rep", F.lit(3)), "chunks")).alias("place"))
    about = materialize(placed.join(reps.select("rep", "n_shingles", "sig"), "rep"), "places")
    meetings = _meetings(_blocks(mixed, about.select("rep", "n_shingles", "sig", "place"), "place"), percent)

    def make():
        sets = Shingler(shingle)

        def one(doc_id, text):
            yield doc_id, np.unique((sets(text)[:LOWEST] >> np.uint64(32)).astype(np.uint32)).tobytes()
        return one

    low = map_rows(texts.join(about.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), make,
                   "rep long, low binary")
    return _between(meetings, about.drop("sig").join(low, "rep"), percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Documents are linked if their
    shingle sets have a Jaccard similarity of at least ``percent`` / 100."""
    return _judged(docs, shingle, percent).drop("text_key")


def keep_single(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, with all their columns; of rows with equal
    doc_id (or none) and equal text one stays. Only rows of repeated pairs shuffle whole."""
    key = "text_key"
    while key in docs.columns:
        key += "_"
    judged = materialize(_judged(docs, shingle, percent).select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("tk"), "kept"), "judged")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))

    def without(rows, gone, how):
        same_id = F.col("doc_id").cast("long").eqNullSafe(F.col("id"))
        return rows.join(gone, same_id & (F.col(key) == F.col("tk")), how)

    rest = without(keyed, judged.filter("not kept").select("id", "tk").distinct(), "left_anti")
    twice = materialize(judged.filter("kept").groupBy("id", "tk").agg(F.count("*").alias("size"))
                        .filter("size > 1").select("id", "tk"), "twice")
    once = without(rest, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return without(rest, twice, "left_anti").unionByName(once).select(docs.columns)


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with their text_key. All Python runs in here;
    what is returned only joins tables."""
    with small_batches(docs.sparkSession):
        return _placed(docs, shingle, percent)


def _placed(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    rows = band_rows(percent / 100)
    sketched = materialize(sketch(docs, shingle, rows), "sketch")
    known = sketched.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(known.groupBy("set_id").agg(F.min("doc_id").alias("first"),
                                                      F.min_by("text_key", "doc_id").alias("text_key"))
                          .withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = (known.join(classes.select("set_id", "first", "rep"), "set_id").filter("doc_id = first")
            .select("rep", "n_shingles", "bands", "sig").dropDuplicates(["rep"]))
    banded = reps.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(banded.join(shared, "key"), "buckets")

    popular = buckets.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = buckets.join(popular, "rep")
    centres = (weighed.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("rep")).alias("minus"),
                                                        F.col("n_shingles").alias("n"))).alias("top"))
               .select("key", (-F.col("top.minus")).alias("a"), F.col("top.weight").alias("wa"),
                       F.col("top.n").alias("na")))
    star = (weighed.join(centres, "key").filter("a <> rep")
            .filter(100 * F.least("na", "n_shingles") >= percent * F.greatest("na", "n_shingles"))
            .groupBy("a", F.col("rep").alias("b")).agg(F.max("wa").alias("wa")))
    star = materialize(star, "star")

    members = (classes.join(buckets.select("rep").distinct(), "rep")
               .select(F.col("first").alias("doc_id"), "text_key", "rep"))
    texts = materialize(_keyed(docs).join(members, ["doc_id", "text_key"])
                        .select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    best = (star.groupBy("b").agg(F.max(F.struct("wa", (-F.col("a")).alias("minus"))).alias("top"))
            .select((-F.col("top.minus")).alias("a"), "b"))
    label = components(_confirm(best, texts, shingle, percent))
    label = components(_confirm(_apart(star.select("a", "b"), label), texts, shingle, percent), label)
    for _ in range(NEAREST):
        blocks = _blocks(_mixed(buckets, label), reps.select("rep", "n_shingles", "sig"))
        label = components(_confirm(_nearest(blocks, percent), texts, shingle, percent), label)
    rest = _rest(buckets, label, reps, best, texts, shingle, percent)
    label = components(_confirm(rest, texts, shingle, percent), label)

    linked = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_id", "first", F.coalesce("component", "rep").alias("number"))
    placed = (linked.join(linked.groupBy("number").agg(F.min("first").alias("component")), "number")
              .select("set_id", "component"))
    return (sketched.select("doc_id", "text_key", "n_shingles", "set_id").join(placed, "set_id", "left")
            .select("doc_id", "text_key", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
                    .alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
