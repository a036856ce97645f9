"""Large JSON arrays and CSV with line ends in quotes, read by many tasks.

Spark's own readers give such a file to one task, since a byte range does not tell
whether it starts inside a string or a record. Here the file is read as text that
ends at every ``}`` (JSON) or line end (CSV), which Spark splits into byte ranges:

1. each range reports what it does to the state: whether it flips "inside quotes",
   and by how much it changes the depth of brackets, for either state at its start;
2. the driver adds these up in file order (one row per range, no text);
3. each range, now knowing how it starts, cuts itself into records. A record that
   crosses a border leaves its parts in a small table, where they are joined.

The records are parsed by ``from_json`` and ``from_csv``. Nothing but the parts at
borders is shuffled. A range must not be cut anew between planning and running:
an unknown start is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path, ship_package

#: Parts of a record at borders, in file order within a range; TITLE: a file's header that goes on behind its range.
WHOLE, HEAD, MIDDLE, TAIL, TITLE = range(5)
_ESCAPE = re.compile(r"\\.", re.S)

#: (inside quotes, depth of brackets)
State = tuple[bool, int]


class Csv:
    """A record ends at a line end outside quotes; a quote inside quotes is doubled,
    fields without quotes hold none. The first record of each file is its header."""

    sep, header = "\n", True

    @staticmethod
    def step(state: State, piece: str) -> State:
        return state[0] ^ (piece.count('"') % 2 == 1), 0

    @staticmethod
    def base(first: str) -> int:
        return 0

    @staticmethod
    def record(text: str) -> str | None:
        text = text[:-1] if text.endswith("\n") else text
        text = text[:-1] if text.endswith("\r") else text
        return text if text.strip(" ") else None


class Json:
    """A record is an object right inside the file's array, or on the top level of
    a file that is none; other values there are left out."""

    sep, header = "}", False

    @staticmethod
    def step(state: State, piece: str) -> State:
        inside, depth = state
        if "\\" in piece:
            piece = _ESCAPE.sub("", piece)
        for i, part in enumerate(piece.split('"')):
            if (i % 2 == 1) == inside:  # this part is outside quotes
                depth += part.count("{") + part.count("[") - part.count("}") - part.count("]")
        return inside ^ (piece.count('"') % 2 == 1), depth

    @staticmethod
    def base(first: str) -> int:
        return 1 if first == "[" else 0

    @staticmethod
    def record(text: str) -> str | None:
        at = text.find("{")
        return text[at:] if at >= 0 else None


def _pieces(spark: SparkSession, path: str, kind) -> DataFrame:
    return spark.read.option("lineSep", kind.sep).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[str]]]:
    """The pieces of one byte range after the other, in file order."""
    def rows():
        for batch in batches:
            file, block, value = (c.to_pylist() for c in batch.columns)
            yield from zip(zip(file, block), value)

    source = rows()
    held = next(source, None)
    while held is not None:
        key, first = held
        held = None

        def mine(key=key, first=first):
            nonlocal held
            yield first
            for k, v in source:
                if k != key:
                    held = (k, v)
                    return
                yield v

        pieces = mine()
        yield key, pieces
        for _ in pieces:  # what the caller left
            pass


def _starts(pieces: DataFrame, kind) -> dict[tuple[int, int], tuple[bool, int, int]]:
    """By byte range: inside quotes or not, depth, and the depth of records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), values in _ranges(batches):
            out, within, first = (False, 0), (True, 0), ""
            for v in values:
                first = first or v.lstrip("\ufeff \t\r\n")[:1]
                out, within = kind.step(out, v + kind.sep), kind.step(within, v + kind.sep)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([out[0]]),
                 pa.array([out[1]], pa.int64()), pa.array([within[1]], pa.int64()), pa.array([first], pa.string())],
                names=["file", "block", "flips", "d0", "d1", "first"])

    rows = pieces.mapInArrow(run, "file long, block long, flips boolean, d0 long, d1 long, first string").collect()
    out, at = {}, None
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if at != r["file"]:
            at, inside, depth, base = r["file"], False, 0, kind.base(r["first"])
        out[at, r["block"]] = (inside, depth, base)
        depth += r["d1"] if inside else r["d0"]
        inside ^= r["flips"]
    return out


def _cut(pieces: DataFrame, kind, starts: dict) -> DataFrame:
    """(file, block, part, text): whole records, and the parts at borders. ``text``
    of a part keeps its separators."""
    last: dict[int, int] = {}
    for file, block in starts:
        last[file] = max(block, last.get(file, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["file", "block", "part", "text"])

        for key, values in _ranges(batches):
            if key not in starts:
                raise RuntimeError("the byte ranges of a file changed since it was opened; read it again")
            inside, depth, base = starts[key]
            state, buffer, size = (inside, depth), [], 0
            part = HEAD if inside or depth > base else WHOLE
            title = kind.header and key[1] == 0  # not yet past the header
            for v in values:
                buffer.append(v + kind.sep)
                state = kind.step(state, buffer[-1])
                if not state[0] and state[1] <= base:
                    text = "".join(buffer)
                    text = kind.record(text) if part == WHOLE else text
                    if text is not None and not title:
                        out.append((*key, part, text))
                        size += len(text)
                    title, buffer, part = title and text is None, [], WHOLE
                    if size > 4 << 20:
                        yield flush()
                        out, size = [], 0
            if buffer and part == WHOLE and key[1] == last[key[0]]:  # the file ends inside a record
                text = kind.record("".join(buffer))
                if text is not None and not title:
                    out.append((*key, WHOLE, text))
            elif buffer:
                out.append((*key, MIDDLE if part == HEAD else TITLE if title else TAIL, "".join(buffer)))
            if out:
                yield flush()
                out = []

    return pieces.mapInArrow(run, "file long, block long, part int, text string")


def records(spark: SparkSession, path: str, kind) -> DataFrame:
    """(file, block, text) of every record of the files under ``path``; ``block``
    is the byte range in which it starts."""
    ship_package(spark)
    pieces = _pieces(spark, path, kind)
    starts = _starts(pieces, kind)
    cut = _cut(pieces, kind, starts)
    whole = cut.filter(F.col("part") == WHOLE).select("file", "block", "text")
    if len(starts) == len({file for file, _ in starts}):  # no file has a border
        return whole
    # in file order each tail begins a record, the parts behind it go on with it
    place = Window.partitionBy("file").orderBy("block", "part")
    parts = materialize(cut.filter(F.col("part") != WHOLE), "record-parts")
    parts = parts.withColumn("record", F.sum((F.col("part") >= TAIL).cast("int")).over(place))
    joined = parts.groupBy("file", "record").agg(
        F.min("block").alias("block"), F.max("part").alias("part"),
        F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p")).filter(F.col("part") != TITLE)
    clean = F.udf(kind.record, "string")
    text = clean(F.array_join(F.transform("p", lambda x: x["text"]), ""))
    return whole.unionByName(joined.select("file", "block", text.alias("text")).filter(F.col("text").isNotNull()))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The objects of JSON arrays (or of files of objects). Without a schema it is
    inferred by Spark over the records, which are written once as lines."""
    found = records(spark, path, Json).select("text")
    if schema is None:
        lines = scratch_path(spark, "json-records")
        # line ends only stand between tokens; as blanks they keep a record on one line
        found.select(F.translate("text", "\r\n", "  ").alias("value")).write.text(lines)
        return spark.read.json(lines)
    return found.select(F.from_json("text", schema).alias("r")).select("r.*")


CSV_OPTIONS = {"escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header in each file, quotes doubled inside quotes, and line ends
    in quotes; without a schema all columns are strings, named by the header."""
    if schema is None:
        schema = spark.read.options(header="true", **CSV_OPTIONS).csv(path).schema
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return records(spark, path, Csv).select(F.from_csv("text", kinds, CSV_OPTIONS).alias("r")).select("r.*")
