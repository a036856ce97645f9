"""Validation of generated examples and the training rows they become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import parse
from .rows import generated_source


def parse_attempts(attempts: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``gen_question`` and ``gen_label`` parsed from the reply."""
    j = parse.parse_generated_json(F.col(response))
    return attempts.withColumn("_j", j).withColumn("gen_question", F.col("_j.question")) \
        .withColumn("gen_label", F.col("_j.error_label")).drop("_j")


def _ok(target: str):
    return ((F.coalesce(F.col("gen_question"), F.lit("")) != "")
            & (F.coalesce(F.col("gen_label"), F.lit("")) != "")
            & F.coalesce(lb.labels_equal(F.col(target), lb.parse_labels_raw(F.col("gen_label"))),
                         F.lit(False)))


def accepted(attempts: DataFrame, target: str = "target_labels") -> DataFrame:
    """Attempts whose question and label are present and whose labels equal
    the target labels (case-insensitive sets of equal length)."""
    return parse_attempts(attempts).filter(_ok(target))


def first_accepted(attempts: DataFrame, key: str = "item_id", attempt: str = "attempt",
                   target: str = "target_labels", response: str = "response") -> DataFrame:
    """The lowest-numbered accepted attempt per item; items with none drop out.
    (An item has one row per attempt.)

    Replies are parsed once, on narrow rows: the verdict is an aggregate's argument,
    since a filter would be pushed below the parsing and repeat it. The other columns
    meet the chosen attempt in one join."""
    got = parse_attempts(attempts.select(key, attempt, target, response), response)
    chosen = F.when(_ok(target), F.struct(attempt, "gen_question", "gen_label"))
    best = got.groupBy(key).agg(F.min(chosen).alias("_best")).filter(F.col("_best").isNotNull())
    return attempts.join(best.select(key, "_best.*"), [key, attempt])


def make_training_row(acc: DataFrame, suffix: str = "_GPT-4") -> DataFrame:
    """Accepted generation -> (item_id, passage, answer, question, source,
    error_label)."""
    return acc.select(
        "item_id", "passage", "answer",
        F.col("gen_question").alias("question"),
        generated_source(F.col("source"), suffix).alias("source"),
        F.col("gen_label").alias("error_label"),
    )

