"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII whitespace at both ends, A-Z lower-cased.
The store holds the hashes of all keys seen so far as *runs*: parquet tables
bucketed and sorted by hash. A batch of documents is reduced to one row per key
(partial aggregates, so a line that a third of the documents hold is one row per
task), shuffled and sorted once, and merge-joined with every run, whose buckets
need neither shuffle nor sort. Keys that no run holds become the batch's own
run; ``FANOUT`` runs of a level are merged into one of the next.

A line of a batch goes if an earlier batch holds its key, or a smaller doc_id of
the same batch. ``dedup`` deals a table into batches of rising doc_id, so that
the smallest doc_id of the whole table keeps its line. All work is DataFrame
expressions.

Defined results: a NULL or empty text is one empty line; keys under
``MIN_CHARS`` code points never go; a line that repeats within one document only
stays; rows with equal doc_id are one document; rows without doc_id are one
document behind all others; an empty table gives an empty table; extra columns
are carried by ``dedup`` and never read. Keys are equal when two 64-bit hashes
with different seeds agree (for 1e12 different lines, odds of 1e-15 of any false
match). A row's dropped positions find it by doc_id and a 64-bit hash of its text.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch_path
from .base import materialize, sha_hex

MIN_CHARS = 10
#: Batches that ``dedup`` deals a table into, and runs of a level that are merged into one.
BATCHES = 6
FANOUT = 3

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def tag_of(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, tag, pos, h1, h2) of every line long enough."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc"), tag_of(F.col("text")).alias("tag"),
                    F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("pos", "key"))
    x = x.filter(F.char_length("key") >= min_chars)
    return x.select("doc", "tag", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit("second"), "key").alias("h2"))


@contextlib.contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While plans are made in here, a bucket of one file counts as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class RunStore:
    """Runs of line hashes under ``path``, by level, newest last. A run is one
    sorted file per bucket. ``manifest`` names what a new session needs to open
    the store again (``RunStore(spark, path, manifest=...)``)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None,
                 fanout: int = FANOUT, manifest: str | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch_path(spark, "line-runs")
        self.buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                      int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        self.levels: list[list[str]] = []
        if manifest:
            state = json.loads(manifest)
            self.path, self.buckets, self.levels = state["path"], state["buckets"], state["levels"]
            for name in sum(self.levels, []):
                self._register(name)

    @property
    def manifest(self) -> str:
        return json.dumps({"path": self.path, "buckets": self.buckets, "levels": self.levels})

    def _register(self, name: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, first BIGINT, again BOOLEAN, old BOOLEAN) "
            f"USING parquet PARTITIONED BY (old) CLUSTERED BY (h1, h2) SORTED BY (h1, h2) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        self.spark.sql(f"MSCK REPAIR TABLE {name}")

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        with _sorted_scans(self.spark):
            (keys.select(*HASH, "first", "again", "old").write.partitionBy("old").bucketBy(self.buckets, *HASH)
             .sortBy(*HASH).option("path", f"{self.path}/{name}").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        gone = self.spark.table(name).limit(0)
        gone._scratch_path = f"{self.path}/{name}"
        self.spark.sql(f"DROP TABLE {name}")
        discard(gone)

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter(~F.col("old")).select(*HASH)

    def add(self, keys: DataFrame) -> DataFrame:
        """Admit one row per key (h1, h2, first, again) and return the keys that
        repeat: ``old`` if a run holds them, ``again`` if the batch does twice."""
        self._compact()
        found = F.lit(False)
        for i, name in enumerate(sum(reversed(self.levels), [])):
            run = self.run(name).select(*HASH, F.lit(True).alias(f"in{i}"))
            keys = keys.join(run.hint("merge"), HASH, "left")
            found = found | F.col(f"in{i}").isNotNull()
        name = self._write(keys.withColumn("old", found))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        # read by path: as a table its buckets would tie the next join to them, and a
        # line that many documents hold could not be split over tasks
        kind = "h1 long, h2 long, first long, again boolean, old boolean"
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}").filter("old or again")

    def _compact(self) -> None:
        """Merge the runs of each full level into one of the next."""
        for i, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self.run(names[0])
                for name in names[1:]:
                    merged = merged.union(self.run(name))
                empty = merged.repartition(self.buckets, *HASH).select(
                    *HASH, F.lit(None).cast("long").alias("first"), F.lit(False).alias("again"),
                    F.lit(False).alias("old"))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(empty))
                self.levels[i] = []
                for name in names:
                    self._drop(name)

    def close(self) -> None:
        """Delete all runs."""
        for name in sum(self.levels, []):
            self._drop(name)
        self.levels = []


def admit(seen: DataFrame, store: RunStore) -> DataFrame:
    """Add a batch's occurrences to the store; (doc, tag, pos) of the lines that go."""
    loose = F.col("doc").isNull()
    keys = seen.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("_last"),
                                   F.bool_or(loose).alias("_loose"))
    again = F.coalesce((F.col("_last") > F.col("first")) | (F.col("_loose") & F.col("first").isNotNull()), F.lit(False))
    repeated = store.add(keys.select(*HASH, "first", again.alias("again")))
    later = F.col("old") | F.coalesce(F.col("first") < F.col("doc"), loose & F.col("first").isNotNull(), F.lit(False))
    return seen.join(repeated, HASH).filter(later).select("doc", "tag", "pos")


def cuts(docs: DataFrame, batches: int) -> list[int]:
    """Batch borders: at most ``batches - 1`` quantiles of doc_id."""
    share = [i / batches for i in range(1, batches)]
    got = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), share, 1000)).first()[0] if share else None
    return sorted(set(got or []))


def dropped_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, tag, drop): the positions of the lines that go, per row that loses any."""
    spark = docs.sparkSession
    borders = cuts(docs, batches)
    at = sum((F.when(F.col("doc") > b, 1).otherwise(0) for b in borders), F.lit(0))
    at = F.when(F.col("doc").isNull(), len(borders)).otherwise(at)
    path = scratch_path(spark, "line-hashes")
    occurrences(docs, min_chars).withColumn("batch", at).write.partitionBy("batch").parquet(path)
    kind = "doc long, tag long, pos int, h1 long, h2 long, batch int"
    seen = spark.read.schema(kind).parquet(path)
    seen._scratch_path = path
    store = RunStore(spark)
    gone = None
    try:
        for i in range(len(borders) + 1):
            part = materialize(admit(seen.filter(F.col("batch") == i).drop("batch"), store), "dropped-lines")
            gone = part if gone is None else gone.unionByName(part)
    finally:
        store.close()
        discard(seen)
    return gone.groupBy("doc", "tag").agg(F.collect_set("pos").alias("drop"))


def dedup(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, out_col: str = "deduped") -> DataFrame:
    """The rows of ``docs`` with ``out_col`` (the text without repeated lines),
    ``n_lines`` and ``n_dropped``."""
    # only ids, hashes and positions are joined below the last join, which carries the rows
    drop = dropped_lines(docs, batches, min_chars).select(
        F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("drop").alias("_drop"))
    doc, tag = F.col("doc_id").cast("long"), tag_of(F.col("text"))
    same = F.col("_doc").eqNullSafe(doc) & (F.col("_tag") == tag)

    def rest(lines: Column) -> Column:
        index = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
        return F.array_join(F.transform(index, lambda i: F.get(lines, i)), "\n")

    lines = lines_of(F.col("text"))
    # the lines are bound once, as a lambda's variable: inlined, they would be split again for each line
    kept = F.get(F.transform(F.array(lines), rest), F.lit(0))
    text = F.when(F.col("_drop").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(kept)
    names = [F.col(f"`{c}`") for c in docs.columns if c not in (out_col, "n_lines", "n_dropped")]
    return docs.join(drop, same, "left").select(
        *names, text.alias(out_col), F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = dedup(slim)
    return out.select("doc_id", "n_lines", "n_dropped", sha_hex(F.col("deduped")).alias("kept_sha256"))
