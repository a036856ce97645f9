"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from qualmark.session import arrow_pieces, materialize, ship_package

__all__ = ["Memo", "documents", "id_text", "in_python", "map_batches", "map_rows", "materialize", "sha_hex", "step"]

#: Rows and bytes gathered before a batch goes back to the JVM.
FLUSH_ROWS = 4096
FLUSH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators read; extra columns never get in the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def sha_hex(col) -> F.Column:
    return F.sha2(col, 256)


def step(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, then let go of what led to it: with the lineage cut, the
    driver's collector can free the finished shuffles, and Spark's cleaner
    deletes their files instead of keeping all steps on disk."""
    out = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]],
             schema: str | StructType) -> DataFrame:
    """Arrow-batched flat map. ``make()`` runs once per task and returns a
    function from one row's values to any number of output tuples. Output is
    flushed by rows and by bytes, so long texts do not pile up in a worker; for
    the same reason a batch turns into Python objects in pieces of both bounds."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    width = len(arrow)
    sized = [i for i, f in enumerate(arrow) if not pa.types.is_primitive(f.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * width
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for piece in arrow_pieces(batch, 256):
                for row in zip(*(c.to_pylist() for c in piece.columns)):
                    for got in fn(*row):
                        out.append(got)
                        for i in sized:
                            held += len(got[i] or ())
                        if held > FLUSH_BYTES or len(out) >= FLUSH_ROWS:
                            yield flush()
                            out, held = [], 0
        if out:
            yield flush()

    return in_python(df, run, kind)


def in_python(df: DataFrame, run: Callable, kind: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package on the workers; all Python stages of the
    operators go through here."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, kind)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Rows filtered or changed batch by batch, all columns carried as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            yield fn(batch)

    return in_python(df, run, df.schema)


class Memo(dict):
    """A bounded cache of a function of one string; long ones are not kept."""

    def __init__(self, fn: Callable, size: int = 150_000, longest: int = 64) -> None:
        self.fn, self.size, self.longest = fn, size, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value
