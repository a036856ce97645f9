"""Operators on small hand-made tables: metrics, voting, weights, sampling."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualmark import vocab
from qualmark.operators import distribution as D
from qualmark.operators import metrics as M
from qualmark.operators import sampling as S
from qualmark.operators import voting as VT


def test_pearson_never_raises(spark):
    s = T.StructType([T.StructField("g", T.StringType()), T.StructField("x", T.DoubleType()),
                      T.StructField("y", T.DoubleType())])
    df = spark.createDataFrame([("const", 1.0, 1.0), ("const", 2.0, 1.0), ("one", 1.0, 2.0)], s)
    got = {r["g"]: (r["n"], r["pearson_r"]) for r in M.pearson_by_group(df, ["g"], "x", "y").collect()}
    assert got == {"const": (2, None), "one": (1, None)}
    assert M.pearson_by_group(df.filter("false"), ["g"], "x", "y").count() == 0


def test_reviewer_nan_never_votes(spark):
    cols = ["check-a", "check-b", "check-c"]
    s = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("error_label", T.StringType())]
                     + [T.StructField(c, T.DoubleType()) for c in cols])
    df = spark.createDataFrame([(1, "No Error", float("nan"), 0.9, 0.9)], s)
    out = VT.vote_filter(df, cols, return_with_score=True).first()
    assert out["vote"] == 2


def test_low_precision_requirements(spark):
    s = T.StructType([T.StructField("error_label", T.StringType())])
    df = spark.createDataFrame([("Vague; Spell Error",), ("Spell Error",)], s)
    lp = vocab.LOW_PRECISION_LABELS
    a = VT.required_thresholds(df, by="threshold", low_precision=lp).collect()
    b = VT.required_thresholds(df, by="vote", low_precision=lp).collect()
    assert [(r.required_thres, r.required_vote) for r in a] == [(0.9, 2), (0.8, 2)]
    assert [(r.required_thres, r.required_vote) for r in b] == [(0.8, 3), (0.8, 2)]
    # no low-precision set: never a stricter rule
    c = VT.required_thresholds(df, by="vote").collect()
    assert [r.required_vote for r in c] == [2, 2]
    with pytest.raises(ValueError):
        VT.vote_filter(df, ["x"], strategy="median")


def test_avg_filter_skips_missing(spark):
    cols = ["c1", "c2"]
    s = T.StructType([T.StructField("item_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in cols])
    df = spark.createDataFrame([(1, None, 0.9), (2, None, None), (3, 0.1, 0.9)], s)
    got = sorted(r.item_id for r in VT.vote_filter(df, cols, "avg", 0.8).collect())
    assert got == [1]


def test_binary_metrics_undefined_is_zero(spark):
    s = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("pred", T.IntegerType())])
    df = spark.createDataFrame([(0, 0), (0, 0)], s)
    r = M.binary_metrics(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 0.0, 0.0, 0.0)


def test_multilabel_micro_between_label_extremes(spark):
    s = T.StructType([T.StructField("y_true", T.ArrayType(T.IntegerType())),
                      T.StructField("y_pred", T.ArrayType(T.IntegerType()))])
    z = [0] * 11
    rows = [([1] + z[1:], [1] + z[1:]), ([0, 1] + z[2:], [1, 0] + z[2:]), ([0, 1] + z[2:], [0, 1] + z[2:])]
    df = spark.createDataFrame(rows, s)
    m = M.multilabel_metrics(df).first()
    rep = {r.row_label: r for r in M.multilabel_report(df).collect()}
    f1s = [rep[l].f1 for l in vocab.LABELS[:2]]
    assert min(f1s) <= m.micro_f1 <= max(f1s)
    assert rep["micro avg"].f1 == m.micro_f1
    assert m.accuracy == pytest.approx(2 / 3, abs=1e-6)


def _dist(spark, rows):
    s = T.StructType([T.StructField("error_label", T.StringType())])
    return D.label_distribution(spark.createDataFrame([(r,) for r in rows], s))


def test_weights_single_label_and_equal_counts(spark):
    w = D.label_weights(_dist(spark, ["Vague", "Vague"])).collect()
    assert len(w) == 1 and w[0].final_weight_norm == pytest.approx(1.0)
    w = D.label_weights(_dist(spark, ["Vague", "Off Topic"])).collect()
    assert all(r.freq_boost == 1.0 for r in w)
    assert sum(r.final_weight_norm for r in w) == pytest.approx(1.0)


def test_weights_boost_rare_labels(spark):
    w = {r.label: r for r in D.label_weights(_dist(spark, ["Vague"] * 8 + ["Off Topic"])).collect()}
    assert 1.2 <= w["Off Topic"].freq_boost < 1.8 and w["Vague"].freq_boost == 1.0


def test_dense_slots_with_hot_group(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("item_id"),
                                     F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"))
    slots, sizes = S.slot_tables(df, "g", "item_id")
    out = slots.join(sizes, "g").groupBy("g").agg(
        F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("k"),
        F.count("*").alias("n"), F.first("group_size").alias("size")).collect()
    for r in out:
        assert r.lo == 0 and r.hi == r.n - 1 and r.k == r.n == r.size


def test_weighted_sample_follows_weights(spark):
    s = T.StructType([T.StructField("label", T.StringType()), T.StructField("final_weight_norm", T.DoubleType())])
    w = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("z", 0.0)], s)
    c = spark.range(0, 20000).withColumnRenamed("id", "item_id")
    got = {r.sampled_label: r["count"] for r in
           S.weighted_label_sample(c, w).groupBy("sampled_label").count().collect()}
    assert sum(got.values()) == 20000 and "z" not in got
    assert abs(got["a"] / 20000 - 0.5) < 0.02 and abs(got["c"] / 20000 - 0.2) < 0.02


def test_split_is_stable_and_disjoint(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "item_id")
    a = S.train_dev_split(df, 10)
    b = S.train_dev_split(df.repartition(7), 10)
    assert a.exceptAll(b).count() == 0
    dev = a.filter("split = 'dev'").count()
    assert 350 < dev < 650 and a.count() == 5000


def test_exact_split_sizes(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "item_id")
    s = S.train_dev_split_exact(df, 10)
    assert s.filter("split = 'dev'").count() == 101 and s.count() == 1001


def test_losses_match_python(spark):
    import math
    rows = [([2.0, -1.0, 0.0] + [0.5] * 8, [1, 0, 1] + [0] * 8), ([-3.0] * 11, [1] * 11)]
    s = T.StructType([T.StructField("logits", T.ArrayType(T.DoubleType())),
                      T.StructField("y_true", T.ArrayType(T.IntegerType()))])
    df = spark.createDataFrame(rows, s)
    w = [2.0] * 11

    def bce(x, y, pw=1.0):
        p = 1 / (1 + math.exp(-x))
        return -(pw * y * math.log(p) + (1 - y) * math.log(1 - p))

    cells = [(x, y) for xs, ys in rows for x, y in zip(xs, ys)]
    b = M.bce_loss(df).first()
    assert b.bce_mean == pytest.approx(sum(bce(x, y) for x, y in cells) / len(cells), abs=1e-6)
    bw = M.bce_loss(df, pos_weight=w).first()
    assert bw.bce_mean == pytest.approx(sum(bce(x, y, 2.0) for x, y in cells) / len(cells), abs=1e-6)
    f = M.focal_loss(df).first()
    foc = [0.25 * (1 - math.exp(-bce(x, y))) ** 2 * bce(x, y) for x, y in cells]
    assert f.focal_mean == pytest.approx(sum(foc) / len(foc), abs=1e-6)
    assert f.focal_sum == pytest.approx(sum(foc), abs=1e-6)
    none = M.focal_loss(df, reduction="none").collect()
    assert len(none[0].focal) == 11 and none[1].focal[0] == pytest.approx(foc[11], abs=1e-9)
