"""Multi-reviewer voting over reviewer-confidence columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.labels import parse_labels_raw
from ..functions.parse import parse_confidence


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _valid(c: Column) -> Column:
    """NULL for NaN so NaN never passes a threshold."""
    return F.when(~F.isnan(c), c)


def required_thresholds(df: DataFrame, label_col: str = "error_label", by: str = "vote",
                        threshold: float = vocab.DEFAULT_REVIEW_THRESHOLD,
                        low_precision: Sequence[str] = ()) -> DataFrame:
    """Adds ``required_thres`` and ``required_vote``.

    ``by='threshold'``: 0.9 for rows with a low-precision label, else
    ``threshold``; 2 votes. ``by='vote'``: 3 votes for such rows, else 2;
    ``threshold`` unchanged.
    """
    if by not in ("vote", "threshold"):
        raise ValueError("by must be 'vote' or 'threshold'")
    low = F.array(*[F.lit(x) for x in low_precision]) if low_precision else \
        F.array().cast("array<string>")
    hit = F.coalesce(F.arrays_overlap(parse_labels_raw(F.col(label_col)), low), F.lit(False))
    if by == "threshold":
        thres = F.when(hit, F.lit(vocab.LOW_PRECISION_THRESHOLD)).otherwise(F.lit(float(threshold)))
        votes = F.lit(vocab.DEFAULT_VOTES)
    else:
        thres = F.lit(float(threshold))
        votes = F.when(hit, F.lit(vocab.LOW_PRECISION_VOTES)).otherwise(F.lit(vocab.DEFAULT_VOTES))
    return df.withColumn("required_thres", thres).withColumn("required_vote", votes.cast("int"))


def count_votes(columns: Sequence[str], thres: Column) -> Column:
    """Number of reviewers whose (non-NULL, non-NaN) score reaches ``thres``."""
    terms = [F.when(_valid(_q(c)) >= thres, 1).otherwise(0) for c in columns]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the non-missing reviewer scores (NULL if none)."""
    vals = F.filter(F.array(*[_valid(_q(c)) for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total, F.size(vals).cast("double"))


def vote_filter(df: DataFrame, columns: Sequence[str], strategy: str = "vote",
                threshold: float = vocab.DEFAULT_REVIEW_THRESHOLD,
                low_precision: Sequence[str] = (), by: str = "vote",
                label_col: str = "error_label", return_with_score: bool = False) -> DataFrame:
    """Keep rows accepted by the reviewers.

    ``strategy='vote'``: votes >= required votes (per-row thresholds).
    ``strategy='avg'``: row mean >= ``threshold``.
    Helper columns are dropped unless ``return_with_score``.
    """
    if strategy == "vote":
        x = required_thresholds(df, label_col, by, threshold, low_precision)
        x = x.withColumn("vote", count_votes(columns, F.col("required_thres")))
        x = x.filter(F.col("vote") >= F.col("required_vote"))
        helpers = ["vote", "required_vote", "required_thres"]
    elif strategy == "avg":
        x = df.withColumn("avg_score", row_mean(columns))
        x = x.filter(F.col("avg_score") >= F.lit(float(threshold)))
        helpers = ["avg_score"]
    else:
        raise ValueError("strategy must be 'vote' or 'avg'")
    return x if return_with_score else x.drop(*helpers)


def merge_reviews(base: DataFrame, reviews: DataFrame,
                  reviewers: Sequence[str] = vocab.REVIEWERS, key: str = "item_id",
                  reviewer_col: str = "reviewer", score_col: str = "confidence") -> DataFrame:
    """Long reviews ``(key, reviewer, confidence)`` -> ``check-<reviewer>``
    columns on the base rows (pivot with listed values; left join keeps
    rows a reviewer skipped as NULL)."""
    wide = (reviews.groupBy(key).pivot(reviewer_col, list(reviewers))
            .agg(F.max(score_col)))
    wide = wide.select(key, *[F.col(r).alias(f"check-{r}") for r in reviewers])
    return base.join(wide, key, "left")


# ---- reviewers that are not known beforehand -----------------------------------

PREFIX = "check-"


def read_reviews(spark: SparkSession, root: str, key: str = "item_id", run: str = "run") -> DataFrame:
    """Review tables under ``root`` (``run=n`` folders) whose columns grow: every
    ``check-<reviewer>`` column that any of the files has, as (key, reviewer, run,
    confidence). Replies may be numbers or text; what is no number is left out."""
    table = spark.read.option("mergeSchema", "true").parquet(root)
    return long_reviews(table, key, run)


def long_reviews(table: DataFrame, key: str = "item_id", run: str = "run") -> DataFrame:
    """``check-<reviewer>`` columns, whatever their names, as rows."""
    found = [c for c in table.columns if c.startswith(PREFIX)]
    order = F.col(run) if run in table.columns else F.lit(0)
    if not found:
        return table.limit(0).select(key, F.lit("").alias("reviewer"), order.cast("long").alias(run),
                                     F.lit(0.0).alias("confidence"))
    cells = [F.struct(F.lit(c[len(PREFIX):]).alias("reviewer"),
                      parse_confidence(_q(c).cast("string")).alias("confidence")) for c in found]
    rows = table.select(key, order.cast("long").alias(run), F.explode(F.array(*cells)).alias("r"))
    rows = rows.select(key, "r.reviewer", run, "r.confidence")
    return rows.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence"))


def review_map(reviews: DataFrame, rule: str = "last", key: str = "item_id", run: str = "run",
               out_col: str = "reviews") -> DataFrame:
    """One map reviewer -> confidence per item. Of several replies of one reviewer
    ``rule`` takes the ``last`` run's (the greatest of that run), the ``max`` or the
    ``mean``. A map holds as many entries as the item has reviewers."""
    of = {"last": F.max_by("confidence", F.struct(run, "confidence")), "max": F.max("confidence"),
          "mean": F.avg("confidence")}
    if rule not in of:
        raise ValueError("rule must be 'last', 'max' or 'mean'")
    one = reviews.groupBy(key, "reviewer").agg(of[rule].alias("confidence"))
    entries = F.array_sort(F.collect_list(F.struct("reviewer", "confidence")))
    return one.groupBy(key).agg(F.map_from_entries(entries).alias(out_col))


def vote_filter_map(df: DataFrame, strategy: str = "vote", threshold: float = vocab.DEFAULT_REVIEW_THRESHOLD,
                    low_precision: Sequence[str] = (), by: str = "vote", label_col: str = "error_label",
                    reviews: str = "reviews", of_present: bool = False, return_with_score: bool = False) -> DataFrame:
    """``vote_filter`` over a map of reviewers instead of fixed columns.
    ``of_present``: an item with fewer reviewers than votes required needs all of
    them (at least one)."""
    scores = F.coalesce(F.map_values(reviews), F.array().cast("array<double>"))
    if strategy == "vote":
        x = required_thresholds(df, label_col, by, threshold, low_precision)
        if of_present:
            x = x.withColumn("required_vote", F.least("required_vote", F.greatest(F.size(scores), F.lit(1))))
        x = x.withColumn("vote", F.size(F.filter(scores, lambda s: s >= F.col("required_thres"))))
        x, helpers = x.filter(F.col("vote") >= F.col("required_vote")), ["vote", "required_vote", "required_thres"]
    elif strategy == "avg":
        total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
        x = df.withColumn("avg_score", F.try_divide(total, F.size(scores).cast("double")))
        x, helpers = x.filter(F.col("avg_score") >= F.lit(float(threshold))), ["avg_score"]
    else:
        raise ValueError("strategy must be 'vote' or 'avg'")
    return x if return_with_score else x.drop(*helpers)
