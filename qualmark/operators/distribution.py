"""Label statistics: distribution, accepted counts and sampling weights.

The distribution is one ``groupBy(label)`` with a partial aggregate, so a
label that holds a third of all tokens costs one partial row per task. Totals
and means come from the aggregated table (one row per label), never from
un-partitioned windows over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import md5_uniform
from ..functions.labels import parse_labels_raw


def label_tokens(df: DataFrame, label_col: str = "error_label",
                 keep_blank: bool = True) -> DataFrame:
    """One row per stripped token (``label``); NULL label strings yield none."""
    toks = df.select(F.explode(parse_labels_raw(F.col(label_col))).alias("label"))
    return toks if keep_blank else toks.filter(F.col("label") != "")


def _with_share(counts: DataFrame) -> DataFrame:
    """Proportion of each label. The total is a scalar subquery over the same
    aggregate, whose exchange is reused; no task gathers all labels."""
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("label", "count",
                         (F.col("count") / total.cast("double")).alias("proportion"))


def label_distribution(df: DataFrame, label_col: str = "error_label",
                       known_only: bool = False) -> DataFrame:
    """``(label, count, proportion)``; blanks counted, NULL rows skipped.
    ``known_only`` leaves out tokens that are no vocabulary label."""
    toks = label_tokens(df, label_col)
    if known_only:
        toks = toks.filter(F.col("label").isin(vocab.LABELS))
    counts = toks.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return _with_share(counts)


def accepted_label_counts(df: DataFrame, label_col: str = "error_label") -> DataFrame:
    """``(label, count)`` of non-blank tokens (e.g. after voting)."""
    return label_tokens(df, label_col, keep_blank=False).groupBy("label").agg(
        F.count(F.lit(1)).alias("count"))


def sort_distribution(dist: DataFrame) -> DataFrame:
    """Count descending, label ascending, with an explicit 1-based rank."""
    return dist.orderBy(F.desc("count"), F.asc("label"))


def label_weights(dist: DataFrame, difficulty: dict | None = None,
                  importance: dict | None = None,
                  min_boost: float = vocab.DEFAULT_MIN_BOOST,
                  max_boost: float = vocab.DEFAULT_MAX_BOOST,
                  seed: int = vocab.SPLIT_SEED) -> DataFrame:
    """Sampling weight per label: proportion x difficulty x importance x boost.

    A label rarer than the mean count gets a boost drawn uniformly from
    [min_boost, max_boost) — seeded from ``md5(seed|label)`` so reruns agree —
    and weights are normalised to sum to 1.

    The mean and the total are windows over the distribution, one row per label, so
    the labeled data are scanned once and no job runs while the plan is built.
    """
    spark = dist.sparkSession
    whole = Window.partitionBy()
    factors = vocab.factor_table(spark, difficulty, importance)
    # the factor table has at most one row per named label: safe to broadcast
    w = dist.join(F.broadcast(factors), "label", "left").select(
        "label",
        F.col("proportion").alias("base_proportion"),
        "count",
        F.coalesce("difficulty", F.lit(1.0)).alias("difficulty"),
        F.coalesce("importance", F.lit(1.0)).alias("importance"),
    )
    mean_count = F.avg("count").over(whole)
    u = md5_uniform(seed, F.col("label"))
    boost = F.when(F.col("count") < mean_count,
                   F.lit(min_boost) + F.lit(max_boost - min_boost) * u).otherwise(F.lit(1.0))
    w = w.withColumn("freq_boost", boost)
    w = w.withColumn("final_weight_raw", F.col("base_proportion") * F.col("difficulty")
                     * F.col("importance") * F.col("freq_boost"))
    return w.withColumn("final_weight_norm", F.col("final_weight_raw") / F.sum("final_weight_raw").over(whole))


def sort_weights(weights: DataFrame) -> DataFrame:
    return weights.orderBy(F.desc("final_weight_norm"), F.asc("label"))
