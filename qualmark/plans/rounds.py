"""Self-training in rounds, with a durable state.

Each round judges the pool rows that are not yet in the training set, adds the
accepted ones and starts again from the larger set, until a round adds nothing
(or ``max_rounds`` are done). The state lives in one shared folder:

    accepted/round=k   the rows round k added, with their predicted label
    models/round=k     what a judge keeps of its training (``trained_judge``)
    log/round=k        one row per finished round, written last

A run that was killed goes on behind the last finished round: rounds with a log
row are read, never trained again; a round cut off between training and log
finds its models and writes its rows anew.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml, passes, prompts
from ..session import path_exists

#: (round, training set, rest of the pool) -> the rest with ``pred_error`` and ``verify_label``.
Judge = Callable[[int, DataFrame, DataFrame], DataFrame]


def _written(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, os.path.join(path, "_SUCCESS"))


def _log(spark: SparkSession, state: str) -> list:
    """The finished rounds, in order."""
    done = []
    while _written(spark, f"{state}/log/round={len(done) + 1}"):
        done.append(spark.read.parquet(f"{state}/log/round={len(done) + 1}").first())
    return done


def round_log(spark: SparkSession, state: str) -> DataFrame:
    """(round, n_train, n_pool, n_added) of the finished rounds."""
    paths = [f"{state}/log/round={i + 1}" for i in range(len(_log(spark, state)))]
    kind = "n_train long, n_pool long, n_added long, round int"
    return spark.read.schema(kind).option("basePath", f"{state}/log").parquet(*paths) if paths else \
        spark.createDataFrame([], kind)


def training_set(train_set: DataFrame, state: str, rounds: int) -> DataFrame:
    """The training set behind ``rounds`` finished rounds; ``round`` is 0 for its first rows."""
    out = train_set.withColumn("round", F.lit(0))
    spark = train_set.sparkSession
    for k in range(1, rounds + 1):
        got = spark.read.schema(train_set.schema).parquet(f"{state}/accepted/round={k}")
        out = out.unionByName(got.withColumn("round", F.lit(k)))
    return out


def self_train(pool: DataFrame, train_set: DataFrame, judge: Judge, state: str, max_rounds: int = 5,
               key: str = "item_id") -> DataFrame:
    """The training set after the last round, each row with the ``round`` that
    added it. ``pool`` has the columns of ``train_set`` but for ``error_label``."""
    spark = pool.sparkSession
    done = _log(spark, state)
    while len(done) < max_rounds and not (done and done[-1]["n_added"] == 0):
        k = len(done) + 1
        now = training_set(train_set, state, k - 1).drop("round")
        rest = pool.join(now.select(key), key, "left_anti")
        judged = judge(k, now, rest)
        added = judged.filter(F.col("verify_label") == 1).withColumn("error_label", F.col("pred_error"))
        added.select(*train_set.columns).write.mode("overwrite").parquet(f"{state}/accepted/round={k}")
        n = spark.read.parquet(f"{state}/accepted/round={k}").count()
        row = (now.count(), rest.count(), n)
        spark.createDataFrame([row], "n_train long, n_pool long, n_added long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{state}/log/round={k}")
        done = _log(spark, state)
    return training_set(train_set, state, len(done))


def with_models(identifier, verifier, rest: DataFrame, model_type: str = "roberta") -> DataFrame:
    """``rest`` with the labels one model gives and the other one's verdict on them."""
    qa = (F.col("question"), F.col("answer"), F.col("passage"))
    pred = ml.identify_errors(identifier, rest.withColumn("text", prompts.identifier_text(*qa, model_type)))
    pred = pred.withColumn("text", prompts.verifier_text(F.col("pred_error"), *qa, model_type))
    return ml.verify_labels(verifier, pred).drop("text")


def trained_judge(train_identifier: Callable[[DataFrame], ml.TextModel],
                  train_verifier: Callable[[DataFrame], ml.TextModel], state: str) -> Judge:
    """A judge that trains both models on each round's training set. A model is
    saved as soon as it is trained, and read if an earlier run has saved it."""
    def model(spark: SparkSession, path: str, train: Callable[[DataFrame], ml.TextModel], data: DataFrame):
        if not _written(spark, path):
            train(data).model.save(spark, path)
        return ml.TextModel(passes.load_model(spark, path))

    def judge(k: int, now: DataFrame, rest: DataFrame) -> DataFrame:
        spark, folder = rest.sparkSession, f"{state}/models/round={k}"
        return with_models(model(spark, f"{folder}/identifier", train_identifier, now),
                           model(spark, f"{folder}/verifier", train_verifier, now), rest)

    return judge
