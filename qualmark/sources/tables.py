"""Table sources and sinks (parquet first; JSON, CSV and text supported).

Readers take an explicit schema when one is known so no inference pass runs
over the data, and column pruning / filter pushdown reach the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QA_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("passage", T.StringType(), True),
    T.StructField("question", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
])

_FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json",
            ".csv": "csv", ".txt": "text"}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scan_table(spark: SparkSession, path: str,
               schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with a schema only its columns are read."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              json_array: bool = False) -> DataFrame:
    """JSON records. ``json_array=True`` reads files that each hold one JSON
    array, by byte ranges (``ranges``); the default reads JSON lines."""
    if json_array:
        from .ranges import read_json
        return read_json(spark, path, schema)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def format_for(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in _FORMATS:
        raise ValueError(f"unsupported table format {ext or '(none)'!r} for {path}")
    return _FORMATS[ext]


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first text of a JSON file is the bracket of an array."""
    head = spark.read.text(path).filter(F.trim("value") != "").first()
    return head is not None and head[0].lstrip().startswith("[")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    """Pick the reader by file extension, or by ``fmt`` for a folder without
    one; raise on an unknown extension. JSON may be lines or one array per file
    (``.json`` only). Arrays and CSV are split by byte ranges."""
    fmt = fmt or format_for(path)
    if fmt == "json":
        array = path.rstrip("/").lower().endswith(".json") and is_json_array(spark, path)
        return scan_json(spark, path, schema, json_array=array)
    if fmt == "csv":
        from .ranges import read_csv
        return read_csv(spark, path, schema)
    reader = spark.read.format(fmt)
    if schema is not None and fmt != "text":
        reader = reader.schema(schema)
    return reader.load(path)


def load_templates(spark: SparkSession, root: str) -> DataFrame:
    """``template(kind, dimension, body)`` from ``<root>/<kind>/<dimension>.txt``.

    Whole files are read as one row each (``wholetext``). The table is tiny
    (one row per kind and dimension) and is broadcast by its users.
    """
    df = (spark.read.text(os.path.join(root, "*", "*.txt"), wholetext=True)
          .select(F.col("value").alias("body"),
                  F.col("_metadata.file_path").alias("_path")))
    parts = F.split(F.col("_path"), "/")
    return df.select(
        F.element_at(parts, -2).alias("kind"),
        F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("dimension"),
        "body",
    )


def sink_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table (optionally partitioned for pruning)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def sink_json(df: DataFrame, path: str) -> None:
    """UTF-8 JSON lines; non-ASCII characters are written as they are."""
    df.write.mode("overwrite").option("encoding", "UTF-8").json(path)


RECORD_END = "\x1e"


def sink_text(df: DataFrame, column: str, path: str, record_end: str = RECORD_END) -> None:
    """One record per row; records may hold line ends, so a separator of its own
    (U+001E) ends them. A record that holds the separator is an error."""
    value = F.col(column)
    safe = F.when(F.contains(value, F.lit(record_end)), F.raise_error(F.lit("a record holds the separator"))
                  ).otherwise(value)
    df.select(safe.cast("string").alias("value")).write.mode("overwrite").option("lineSep", record_end).text(path)


def read_text(spark: SparkSession, path: str, record_end: str = RECORD_END) -> DataFrame:
    """The records of ``sink_text``, as ``value``."""
    return spark.read.option("lineSep", record_end).text(path)


def save_templates(spark: SparkSession, rows, root: str) -> None:
    """Write (kind, dimension, body) as ``<root>/<kind>/<dimension>.txt`` in the
    cluster's file system (some twenty small files)."""
    sc = spark.sparkContext
    for kind, dimension, body in rows:
        path = sc._jvm.org.apache.hadoop.fs.Path(os.path.join(root, kind, f"{dimension}.txt"))
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(body.encode("utf-8")))
        finally:
            out.close()
