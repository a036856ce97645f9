"""Seeded sampling and splitting without driver loops or global sorts.

* Randomness is ``md5(seed|key)`` so draws are stable under repartitioning
  and task retries.
* Per-label slots are dense ranks computed with a salted two-level scheme
  (bucket counts, then a rank inside each bucket), so a label holding a third
  of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import md5_u32, md5_uniform
from ..functions.labels import parse_labels

RANK_BUCKET_BITS = 16  # hash buckets per group for dense ranking
DRAW_BUCKETS = 1024  # buckets of [0,1) for the weighted range join


def candidate_slice(df: DataFrame, n: int = vocab.CANDIDATE_SLICE,
                    key: str = "item_id") -> DataFrame:
    """First ``n`` rows by ``key`` (top-n: a bounded sort per task)."""
    return df.orderBy(key).limit(n)


def rows_with_label(df: DataFrame, label_col: str = "error_label",
                    key: str = "item_id") -> DataFrame:
    """``(label, key)`` for every vocabulary label a row carries."""
    return df.select(key, F.explode(F.array_distinct(parse_labels(F.col(label_col))))
                     .alias("label"))


def slot_tables(df: DataFrame, group: str, key: str, seed: int = vocab.SPLIT_SEED,
                slot_col: str = "slot", size_col: str = "group_size"):
    """(slotted rows, group sizes). Each row gets a 0-based dense ``slot``
    inside ``group``, ordered by ``md5(seed|key)`` then ``key``.

    Skew-safe: ranks are computed inside (group, hash bucket) and offset by the
    bucket counts, so a hot group is spread over up to 65,536 sub-groups. The
    sizes table (one row per group) comes from the same count table."""
    h = md5_u32(seed, F.col(key))
    x = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 32 - RANK_BUCKET_BITS))
    counts = x.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(group, "_b",
                         F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    sizes = counts.groupBy(group).agg(F.sum("_n").alias(size_col))
    w_in = Window.partitionBy(group, "_b").orderBy("_h", key)
    ranked = x.withColumn("_rn", F.row_number().over(w_in))
    out = ranked.join(offs, [group, "_b"])
    out = out.withColumn(slot_col, (F.col("_off") + F.col("_rn") - 1).cast("long")) \
        .drop("_h", "_b", "_rn", "_off")
    return out, sizes


def weight_intervals(weights: DataFrame, label: str = "label",
                     weight: str = "final_weight_norm") -> DataFrame:
    """``(label, lo, hi)`` cumulative intervals in label order; the last
    upper bound is forced to 1. The weights table has one row per label."""
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = weights.select(label, F.sum(weight).over(w).alias("_cum"),
                         F.lead(label).over(Window.orderBy(label)).alias("_next"))
    prev = F.lag("_cum", 1, 0.0).over(Window.orderBy(label))
    return cum.select(label, prev.alias("lo"),
                      F.when(F.col("_next").isNull(), F.lit(1.0)).otherwise(F.col("_cum")).alias("hi"))


def weighted_label_sample(candidates: DataFrame, weights: DataFrame,
                          seed: int = vocab.SPLIT_SEED, key: str = "item_id",
                          label: str = "label", weight: str = "final_weight_norm",
                          out_col: str = "sampled_label") -> DataFrame:
    """Draw one label per candidate with probability = normalised weight.

    ``u = md5(seed|key)`` in [0,1); the label whose interval holds ``u`` wins.
    The range join is made an equi-join on a bucket of [0,1): each interval is
    listed under every bucket it overlaps (at most labels + buckets rows);
    whether that side is broadcast is decided at run time from its size.
    """
    iv = weight_intervals(weights, label, weight)
    b = float(DRAW_BUCKETS)
    lo_b = F.floor(F.col("lo") * b).cast("int")
    hi_b = F.least(F.floor(F.col("hi") * b).cast("int"), F.lit(DRAW_BUCKETS - 1))
    iv = iv.filter(F.col("hi") > F.col("lo")).select(
        F.col(label).alias(out_col), "lo", "hi",
        F.explode(F.sequence(lo_b, hi_b)).alias("_bucket"))
    c = candidates.withColumn("_u", md5_uniform(seed, F.col(key)))
    c = c.withColumn("_bucket", F.least(F.floor(F.col("_u") * b).cast("int"),
                                        F.lit(DRAW_BUCKETS - 1)))
    j = c.join(iv, (c["_bucket"] == iv["_bucket"]) & (c["_u"] >= iv["lo"]) & (c["_u"] < iv["hi"]))
    return j.drop("_u", "_bucket", "lo", "hi")


def attach_few_shot(candidates: DataFrame, seeds: DataFrame, label_col: str = "sampled_label",
                    seed_label_col: str = "error_label", seed: int = vocab.SPLIT_SEED,
                    key: str = "item_id", seed_key: str = "item_id",
                    prefix: str = "ex_") -> DataFrame:
    """One seed example per candidate among the seeds carrying the candidate's
    label (stripped tokens, as the label distribution counts them).
    The seed for a candidate is slot ``md5(seed|shot|key) mod n_label``."""
    from ..functions.labels import parse_labels_raw
    # ranks and draws run on keys alone; the texts meet the pairs at the end
    toks = seeds.select(seed_key, F.explode(F.array_distinct(
        parse_labels_raw(F.col(seed_label_col)))).alias(label_col))
    slotted, sizes = slot_tables(toks, label_col, seed_key, seed)
    ex = slotted.select(label_col, "slot", F.col(seed_key).alias(prefix + seed_key))
    c = candidates.select(key, label_col).join(sizes, label_col)
    c = c.withColumn("slot", F.pmod(md5_u32(seed, F.lit("shot"), F.col(key)),
                                    F.col("group_size")).cast("long"))
    pairs = c.join(ex, [label_col, "slot"]).select(key, label_col, prefix + seed_key)
    texts = seeds.select(*[F.col(c).alias(prefix + c) for c in seeds.columns])
    return candidates.join(pairs, [key, label_col]).join(texts, prefix + seed_key)


def uniform_sample_one(df: DataFrame, seed: int = vocab.SPLIT_SEED,
                       key: str = "item_id") -> DataFrame:
    """One row chosen uniformly (smallest ``md5(seed|key)``), as a top-1."""
    return df.orderBy(md5_u32(seed, F.col(key)), F.col(key)).limit(1)


def uniform_few_shot(candidates: DataFrame, seeds: DataFrame, seed: int = vocab.SPLIT_SEED,
                     key: str = "item_id", seed_key: str = "item_id",
                     prefix: str = "ex_") -> DataFrame:
    """Uniform seed per candidate (no label targeting): slot
    ``md5(seed|shot|key) mod n_seeds``; ``n_seeds`` is a scalar subquery. Seeds are
    ranked by key alone; their other columns meet the chosen pairs at the end."""
    slotted, _ = slot_tables(seeds.select(seed_key, F.lit(0).alias("_all")), "_all", seed_key, seed)
    n = seeds.agg(F.count(F.lit(1))).scalar()
    c = candidates.withColumn("slot", F.pmod(md5_u32(seed, F.lit("shot"), F.col(key)), n).cast("long"))
    pairs = c.join(slotted.select("slot", F.col(seed_key).alias(prefix + seed_key)), "slot").drop("slot")
    return pairs.join(seeds.select(*[F.col(c).alias(prefix + c) for c in seeds.columns]), prefix + seed_key)


def split_bucket(key_col, seed: int = vocab.SPLIT_SEED, buckets: int = 100):
    return F.pmod(md5_u32(seed, key_col), F.lit(buckets)).cast("int")


def train_dev_split(df: DataFrame, dev_percent: int = vocab.IDENTIFIER_DEV_SHARE,
                    key: str = "item_id", seed: int = vocab.SPLIT_SEED) -> DataFrame:
    """Adds ``split`` in {train, dev}: dev when ``md5(seed|key) mod 100 <
    dev_percent``. Stable under repartitioning; sizes are close to the share."""
    return df.withColumn("split", F.when(split_bucket(F.col(key), seed) < dev_percent,
                                         F.lit("dev")).otherwise(F.lit("train")))


def train_dev_split_exact(df: DataFrame, dev_percent: int = vocab.IDENTIFIER_DEV_SHARE,
                          key: str = "item_id", seed: int = vocab.SPLIT_SEED) -> DataFrame:
    """Exact sizes: the ``ceil(n * dev_percent / 100)`` rows with the smallest
    ``md5(seed|key)`` form the dev split. The bucket counts decide every hash
    bucket but the one that the limit cuts; only that bucket's rows are ranked."""
    h = md5_u32(seed, F.col(key))
    x = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 32 - RANK_BUCKET_BITS))
    counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # windows over the bucket-count table only (at most 65,536 rows)
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n_dev = F.ceil(F.sum("_n").over(Window.partitionBy()) * F.lit(dev_percent) / F.lit(100))
    room = n_dev - F.coalesce(F.sum("_n").over(w), F.lit(0))  # dev rows left for this bucket on
    r = x.join(counts.select("_b", "_n", room.alias("_room")), "_b")
    whole = r.filter((F.col("_room") <= 0) | (F.col("_room") >= F.col("_n"))).withColumn(
        "split", F.when(F.col("_room") > 0, F.lit("dev")).otherwise(F.lit("train")))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    cut = r.filter((F.col("_room") > 0) & (F.col("_room") < F.col("_n"))).withColumn(
        "split", F.when(rn <= F.col("_room"), F.lit("dev")).otherwise(F.lit("train")))
    return whole.unionByName(cut).drop("_h", "_b", "_n", "_room")


def grouped_split(df: DataFrame, group: str = "doc_id", label: str = "error_label",
                  dev_percent: int = vocab.IDENTIFIER_DEV_SHARE, key: str = "item_id",
                  seed: int = vocab.SPLIT_SEED) -> DataFrame:
    """Adds ``split``: whole groups (passages) go to one side, each label's share
    is kept and sizes are exact to half a group.

    Dev gets ``ceil(n * dev_percent / 100)`` rows, dealt over the labels by largest
    remainder (ties: the label that sorts first). A label's groups stand in
    ``md5(seed|group)`` order; those whose middle lies within its quota are dev. A
    group counts under the least of its labels; a row without a group is one of its
    own. Sums run over hash buckets first, so no task orders a whole label."""
    g = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("k"), F.col(key).cast("string")))
    x = df.withColumn("_g", g)
    sizes = x.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_l"))
    h = md5_u32(seed, F.col("_g"))
    sizes = sizes.withColumn("_l", F.coalesce("_l", F.lit(""))).withColumn("_h", h).withColumn(
        "_b", F.shiftright("_h", 32 - RANK_BUCKET_BITS))
    buckets = sizes.groupBy("_l", "_b").agg(F.sum("_n").alias("_bn"))
    ahead = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_l", "_b", F.coalesce(F.sum("_bn").over(ahead), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_l", "_b").orderBy("_h", "_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sizes.withColumn("_end", F.sum("_n").over(inside)).join(offsets, ["_l", "_b"]).join(
        label_quotas(buckets.groupBy("_l").agg(F.sum("_bn").alias("_ln")), dev_percent), "_l")
    middle = 2 * (F.col("_off") + F.col("_end")) - F.col("_n")
    side = F.when(middle <= 2 * F.col("_quota"), "dev").otherwise("train")
    return x.join(placed.select("_g", side.alias("split")), "_g").drop("_g")


def label_quotas(totals: DataFrame, percent: int, label: str = "_l", n: str = "_ln", out_col: str = "_quota") -> DataFrame:
    """Largest-remainder shares of ``ceil(total * percent / 100)`` per label. The
    windows run over the table of totals, one row per label."""
    whole = Window.partitionBy()
    part = F.floor(F.col(n) * percent / 100).cast("long")
    want = F.ceil(F.sum(n).over(whole) * percent / 100).cast("long")
    rank = F.row_number().over(Window.orderBy(F.desc(F.col(n) * percent % 100), label))
    x = totals.select(label, part.alias("_part"), rank.alias("_rank"), want.alias("_want"))
    left = F.col("_want") - F.sum("_part").over(whole)
    return x.select(label, (F.col("_part") + (F.col("_rank") <= left).cast("long")).alias(out_col))


def given_dev_split(df: DataFrame, dev: DataFrame, group: str = "doc_id") -> DataFrame:
    """``df`` against a dev table given by the caller: all of ``dev``, and the rows
    of ``df`` whose group has none there."""
    train = df.join(dev.select(group), group, "left_anti").withColumn("split", F.lit("train"))
    return train.unionByName(dev.withColumn("split", F.lit("dev")))
