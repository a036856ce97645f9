"""Row selection, column shaping and key joins between evaluation tables.

Joins are on a stable ``item_id`` (never on row position), so results do not
depend on partitioning and survive task retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions import parse

RESPONSE_KEYS = ["item_id", "dimension", "model"]


def drop_unlabeled(df: DataFrame, columns: Sequence[str] = ("error_label", "label")) -> DataFrame:
    """Drop rows with a NULL in whichever of ``columns`` exist."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(subset=present) if present else df


def fill_empty(df: DataFrame) -> DataFrame:
    """NULL strings -> ``''`` (numeric columns keep their NULLs)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill("", subset=cols) if cols else df


def cast_label(df: DataFrame, label: str = "label",
               text_columns: Sequence[str] = ()) -> DataFrame:
    """Integer label; optional text columns rendered as strings (NULL kept)."""
    out = df.withColumn(label, F.col(label).cast("int"))
    for c in text_columns:
        out = out.withColumn(c, F.col(c).cast("string"))
    return out


def with_score(df: DataFrame, response: str = "response", score: str = "score",
               thinking: str | None = None) -> DataFrame:
    """Adds the score of the reply's content, which is what stands behind the
    last reasoning marker; ``thinking`` names a column for the reasoning."""
    reasoning, content = parse.split_thinking(F.col(response))
    out = df.withColumn(score, parse.extract_score(content))
    return out.withColumn(thinking, reasoning) if thinking else out


def drop_unparsed(df: DataFrame, score: str = "score") -> DataFrame:
    return df.filter(F.col(score) != vocab.NO_SCORE)


def exclude_clean(df: DataFrame, label: str = "error_label") -> DataFrame:
    """Drop rows whose label is exactly ``No Error``; a NULL label stays."""
    return df.filter(~F.col(label).eqNullSafe(F.lit("No Error")))


def model_family(model_col, sep: str = "-"):
    """Text before the first ``sep`` of a model id (``gpt-4o`` -> ``gpt``)."""
    return F.substring_index(model_col, sep, 1)


def generated_source(source_col, suffix: str = "_GPT-4"):
    """Source tag of a generated row: original source up to ``_`` + suffix."""
    return F.concat(F.substring_index(source_col, "_", 1), F.lit(suffix))


def wide_scores(scored: DataFrame, dimensions: Sequence[str], models: Sequence[str],
                key: str = "item_id") -> DataFrame:
    """Long ``(item, dimension, model, response, score)`` -> one row per item
    with ``<dim>_<model>`` (response), ``<dim>_<model>_score`` and
    ``<dim>_<model>_thinking`` columns, and ``n_unlisted``: replies of models or
    dimensions that are not listed. Of several replies for one cell the one that
    sorts last is taken. One aggregate gathers an item's replies (as many as
    cells), the columns are picked from it.
    """
    names = [f"{d}_{m}" for d in dimensions for m in models]
    cell = F.struct(F.concat_ws("_", "dimension", "model").alias("dm"), "response", "score")
    wide = scored.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    out = [F.col(key), F.size(F.filter("cells", lambda c: ~c["dm"].isin(names))).alias("n_unlisted")]
    def cell_of(name: str):
        return F.try_element_at(F.filter("cells", lambda c: c["dm"] == name), F.lit(-1))

    for n in names:
        last = cell_of(n)
        out += [last["response"].alias(n), last["score"].alias(f"{n}_score"),
                parse.split_thinking(last["response"])[0].alias(f"{n}_thinking")]
    return wide.select(*out)


def pair_rating_pred(ratings: DataFrame, preds: DataFrame,
                     keys: Sequence[str] = ("item_id", "dimension")) -> DataFrame:
    """Human rating and model score on one row (inner equi-join; see
    ``count_unmatched`` for the ratings that find no score)."""
    return ratings.join(preds, list(keys), "inner")


def count_unmatched(ratings: DataFrame, preds: DataFrame, by: str = "dimension",
                    keys: Sequence[str] = ("item_id", "dimension")) -> DataFrame:
    """Per ``by``: rated rows, and those without any prediction."""
    found = preds.select(*keys).distinct().withColumn("_found", F.lit(True))
    return (ratings.join(found, list(keys), "left").groupBy(by)
            .agg(F.count(F.lit(1)).alias("n_rated"), F.count_if(F.col("_found").isNull()).alias("n_unmatched")))


def pending_rows(requests: DataFrame, done: DataFrame,
                 keys: Sequence[str] = RESPONSE_KEYS) -> DataFrame:
    """Requests not yet answered: the resume set of an incremental run.
    (An anti join never duplicates rows, so ``done`` needs no distinct.)"""
    return requests.join(done.select(*keys), list(keys), "left_anti")


def join_recorded_responses(requests: DataFrame, recorded: DataFrame,
                            keys: Sequence[str] = RESPONSE_KEYS) -> DataFrame:
    """Attach already recorded evaluator replies; a request without one stays,
    with NULLs."""
    return requests.join(recorded, list(keys), "left")


def attach_predictions(rows: DataFrame, preds: DataFrame, key: str = "item_id") -> DataFrame:
    """Attach predictions; a row without one stays, with NULLs."""
    return rows.join(preds, key, "left")
