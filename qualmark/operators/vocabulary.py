"""The label vocabulary as tables, in versions.

    labels(version, idx, label, description)      one row per label
    relevance(version, dimension, label)          which labels bear on a dimension
    aliases(version, alias, label)                other spellings

A version's maps reach every row as scalar subqueries over these tables (one row per
label and version), so versions can be compared side by side in one job and changed
without new code. ``fixed_tables`` writes the package's own vocabulary as such tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from ..functions.labels import parse_labels_raw
from .prompts import _qa_slots, attach_template

LABEL_SCHEMA = "version string, idx int, label string, description string"
RELEVANCE_SCHEMA = "version string, dimension string, label string"
ALIAS_SCHEMA = "version string, alias string, label string"
#: Between the version and the name in a map's keys; no name holds it.
SEP = "\x1f"

DESCRIPTIONS, RELEVANT, ALIASES = "_descriptions", "_relevant", "_aliases"


@dataclass
class Vocabulary:
    labels: DataFrame
    relevance: DataFrame
    aliases: DataFrame

    def save(self, path: str) -> None:
        for name in ("labels", "relevance", "aliases"):
            getattr(self, name).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the maps that ``parse``, ``relevant`` and ``describe`` read."""
        def one_map(table: DataFrame, key: str, value: Column) -> Column:
            entry = F.struct(_key(F.col("version"), F.col(key)), value)
            return table.agg(F.map_from_entries(F.collect_list(entry))).scalar()

        # one row per key: of several the least
        named = self.labels.groupBy("version", "label").agg(F.min("description").alias("description"))
        other = self.aliases.groupBy("version", "alias").agg(F.min("label").alias("label"))
        bears = self.relevance.groupBy("version", "dimension").agg(F.collect_set("label").alias("labels"))
        return df.withColumns({
            DESCRIPTIONS: one_map(named, "label", F.coalesce("description", F.lit(""))),
            ALIASES: one_map(other, "alias", F.col("label")),
            RELEVANT: one_map(bears, "dimension", F.col("labels"))})


def _key(version: Column, name: Column) -> Column:
    return F.concat(version, F.lit(SEP), name)


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary(*(spark.read.parquet(f"{path}/{name}") for name in ("labels", "relevance", "aliases")))


def fixed_tables(spark: SparkSession, version: str = "fixed") -> Vocabulary:
    labels = [(version, i, name, vocab.describe_label_line(name)) for i, name in enumerate(vocab.LABELS)]
    relevance = [(version, d, name) for d, names in vocab.DIMENSION_LABELS.items() for name in names]
    aliases = [(version, a, name) for a, name in vocab.LABEL_ALIASES.items()]
    return Vocabulary(spark.createDataFrame(labels, LABEL_SCHEMA), spark.createDataFrame(relevance, RELEVANCE_SCHEMA),
                      spark.createDataFrame(aliases, ALIAS_SCHEMA))


def parse(text: Column, version: Column) -> Column:
    """The labels that the version knows, in written order, spellings unified."""
    named = F.transform(parse_labels_raw(text), lambda x: F.coalesce(
        F.try_element_at(F.col(ALIASES), _key(version, x)), x))
    return F.filter(named, lambda x: F.map_contains_key(F.col(DESCRIPTIONS), _key(version, x)))


def relevant(labels: Column, dimension: Column, version: Column) -> Column:
    known = F.try_element_at(F.col(RELEVANT), _key(version, dimension))
    return F.filter(labels, lambda x: F.coalesce(F.array_contains(known, x), F.lit(False)))


def describe(labels: Column, version: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: F.try_element_at(F.col(DESCRIPTIONS), _key(version, x))), "\n")


def render_error_prompt(df: DataFrame, templates: DataFrame, vocabulary: Vocabulary, label_col: str = "error_label",
                        out_col: str = "prompt") -> DataFrame:
    """``prompts.render_error_prompt`` under the vocabulary version in each row's
    ``version``; rows have a ``dimension``."""
    x = vocabulary.attach(attach_template(df, templates, "error"))
    version = F.col("version")
    errors = relevant(parse(F.col(label_col), version), F.col("dimension"), version)
    filled = tx.fill_slots(F.col("template"), _qa_slots() + [("#error", describe(errors, version))])
    return x.withColumn(out_col, filled).drop("template", DESCRIPTIONS, ALIASES, RELEVANT)
