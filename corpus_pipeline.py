"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and reread by the next. All but the last return the columns of ``documents``.

1. quality classifier: documents that co-training rejects go;
2. near duplicates (five words, similarity 0.8): the smallest doc_id of each
   group stays, and one of the rows with equal doc_id (or none) and equal text;
3. benchmark decontamination: contaminated documents go, judged row by row;
4. personal data: spans are masked in the text, ``n_chars`` follows;
5. byte-level BPE: token ids, and whether decoding gives the text back.

An empty table passes through all stages; a NULL text is a text without words.
Rows without doc_id are near copies of nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualmark.llm import bpe, cotrain, decontam, minhash, pii
from qualmark.llm.base import documents, materialize
from qualmark.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.keep_good(docs, cotrain.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_single(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("near-duplicate removal", near_dedup),
          ("benchmark decontamination", decontaminate), ("personal data", personal_data),
          ("byte-level BPE", tokenize)]

#: The stages train models and confirm similarities; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
