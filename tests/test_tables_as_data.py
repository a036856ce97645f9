"""Reviewers that are not known beforehand, vocabularies as tables."""

import pytest
from pyspark.sql import functions as F

from qualmark import vocab
from qualmark.operators import prompts, vocabulary, voting


def test_columns_that_grow(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, 0.9, 0.2), (2, None, 0.7)], "item_id long, `check-a` double, `check-b` double") \
        .write.parquet(f"{root}/run=1")
    spark.createDataFrame([(1, 0.4, "0.8"), (2, None, "n/a"), (3, float("nan"), " 1.0\n")],
                          "item_id long, `check-a` double, `check-new` string").write.parquet(f"{root}/run=2")
    reviews = voting.read_reviews(spark, root)
    for rule, a1 in (("last", 0.4), ("max", 0.9), ("mean", 0.65)):
        got = {r.item_id: r.reviews for r in voting.review_map(reviews, rule).collect()}
        assert got[1] == {"a": pytest.approx(a1), "b": 0.2, "new": 0.8}
        assert got[2] == {"b": 0.7} and got[3] == {"new": 1.0}
    with pytest.raises(ValueError):
        voting.review_map(reviews, "first")
    none = spark.createDataFrame([(1, 2)], "item_id long, other int")
    assert voting.long_reviews(none).collect() == []


def test_map_votes_equal_column_votes(spark):
    """With three reviewers the map gives what the fixed columns give."""
    rows = [(i, ["Vague", "Off Topic", "No Error; Vague"][i % 3], *[None if (i * k) % 7 == 0 else (i * k % 11) / 10 for k in (3, 5, 9)])
            for i in range(1, 80)]
    wide = spark.createDataFrame(rows, "item_id long, error_label string, `check-a` double, `check-b` double, `check-c` double")
    cols = ["check-a", "check-b", "check-c"]
    base = wide.select("item_id", "error_label").join(voting.review_map(voting.long_reviews(wide)), "item_id", "left")
    for kw in ({}, {"by": "threshold", "threshold": 0.5}, {"strategy": "avg", "threshold": 0.5}):
        want = {r.item_id for r in voting.vote_filter(wide, cols, low_precision=["Vague"], **kw).collect()}
        got = {r.item_id for r in voting.vote_filter_map(base, low_precision=["Vague"], **kw).collect()}
        assert got == want and want
    few = base.filter(F.size("reviews") < 3)
    assert voting.vote_filter_map(few, threshold=0.0, low_precision=vocab.LABELS).count() == 0
    assert voting.vote_filter_map(few, threshold=0.0, low_precision=vocab.LABELS, of_present=True).count() == \
        few.filter(F.size("reviews") > 0).count()


def test_fixed_tables_render_as_the_package(spark, tmp_path):
    path = str(tmp_path / "vocabulary")
    vocabulary.fixed_tables(spark, "x").save(path)
    v = vocabulary.load_vocabulary(spark, path)
    labels = ["Vague;Grammatical Error; ;Bogus", "", None, "Off Topic;Off Topic;Incomplete", "No Error"]
    df = spark.createDataFrame([(i, "p", "q", "a", x) for i, x in enumerate(labels)],
                               "item_id long, passage string, question string, answer string, error_label string")
    df = prompts.all_dimensions(df)
    t = prompts.packaged_templates(spark)
    want = {(r.item_id, r.dimension): r.prompt for r in prompts.render_error_prompt(df, t).collect()}
    got = vocabulary.render_error_prompt(df.withColumn("version", F.lit("x")), t, v).collect()
    assert {(r.item_id, r.dimension): r.prompt for r in got} == want
    other = vocabulary.render_error_prompt(df.withColumn("version", F.lit("unknown")), t, v)
    assert other.filter(F.col("error_label").isNotNull()).filter(F.contains("prompt", F.lit("* "))).count() == 0
