"""Model stages: retrying completion, identifier and verifier pipelines."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualmark import vocab
from qualmark.functions import text as tx
from qualmark.operators import completion as C
from qualmark.operators import ml


def _messages_df(spark, n=6):
    df = spark.range(0, n).withColumnRenamed("id", "item_id")
    return df.withColumn("messages", tx.build_messages("sys", F.concat(F.lit("p"), F.col("item_id").cast("string"))))


def test_completion_retries_then_succeeds(spark, tmp_path):
    folder = str(tmp_path)

    def flaky(batch):
        import os
        # fail on the first call of each Python worker process
        flag = os.path.join(folder, "worker-%d" % os.getpid())
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("transient")
        return [m[-1]["content"].upper() for m in batch]

    out = C.complete_batch(_messages_df(spark), flaky, wait_s=0.0).collect()
    assert sorted(r.response for r in out) == sorted("P%d" % i for i in range(6))


def test_completion_gives_empty_after_failures(spark):
    def broken(batch):
        raise RuntimeError("down")
    out = C.complete_batch(_messages_df(spark, 3), broken, max_tries=2, wait_s=0.0).collect()
    assert [r.response for r in out] == ["", "", ""]


def _planted(spark, n=400):
    """Texts that mention 'vague' carry Vague; others No Error."""
    rows = []
    for i in range(n):
        if i % 2:
            rows.append((i, f"what about the vague thing number {i % 7}", ["Vague"], 1))
        else:
            rows.append((i, f"when did the event {i % 5} happen exactly", ["No Error"], 0))
    s = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("labels", T.ArrayType(T.StringType())),
                      T.StructField("label", T.IntegerType())])
    return spark.createDataFrame(rows, s)


def test_identifier_learns_planted_signal(spark):
    df = _planted(spark)
    m = ml.train_identifier(df, num_features=1 << 12)
    rows = ml.identify_errors(m, df, need_prob=True).collect()
    assert len(rows) == 400
    assert all(r.pred_error == ("Vague" if r.item_id % 2 else "No Error") for r in rows)
    for r in rows[:20]:
        for lab in vocab.LABELS:
            assert 0.0 <= r[f"{lab}_prob"] <= 1.0


def test_verifier_and_selection(spark):
    df = _planted(spark)
    m = ml.train_verifier(df, num_features=1 << 12)
    rows = ml.verify_labels(m, df).collect()
    assert all(r.verify_label == r.label and (r.positive_prob > 0.5) == (r.label == 1) for r in rows)
    best, scores = ml.select_model(df.filter("item_id % 5 > 0"), df.filter("item_id % 5 = 0"), (0.0, 100.0),
                                   num_features=1 << 12, max_passes=4)
    assert [r for r, _, _ in scores] == [0.0, 100.0]
    assert max(s for _, s in best.history) == max(s for _, _, s in scores)


def test_completion_routed_by_model(spark):
    df = _messages_df(spark, 4).withColumn(
        "model", F.element_at(F.array(F.lit("gpt-4o"), F.lit("claude-x"), F.lit("other"),
                                      F.lit("gpt-4o")), (F.col("item_id") % 4 + 1).cast("int")))
    fns = {"gpt": lambda b: ["G"] * len(b), "claude": lambda b: ["C"] * len(b)}
    got = {r.item_id: r.response for r in C.complete_routed(df, fns).collect()}
    assert got == {0: "G", 1: "C", 2: "", 3: "G"}


def test_completion_keep_order(spark):
    df = _messages_df(spark, 3).withColumn("tag", F.lit("t"))
    out = C.complete_batch(df, lambda b: ["r"] * len(b), keep=["tag", "item_id"])
    assert out.columns == ["tag", "item_id", "response"]
    assert sorted(r.item_id for r in out.collect()) == [0, 1, 2]


def test_resume_scoring_only_pending(spark, tmp_path):
    from qualmark.plans import jobs
    req = _messages_df(spark, 6).withColumn("dimension", F.lit("fluency")).withColumn("model", F.lit("m"))
    calls = spark.sparkContext.accumulator(0)

    def fn(batch):
        calls.add(len(batch))
        return ["score: 2"] * len(batch)

    sink = str(tmp_path / "sink")
    jobs.resume_scoring(req.filter("item_id < 2"), sink, fn)
    jobs.resume_scoring(req, sink, fn)
    out = jobs.resume_scoring(req, sink, fn)  # finished: nothing pending
    assert out.count() == 6 and out.select("item_id").distinct().count() == 6
    assert calls.value == 6
    assert {r.score for r in out.collect()} == {2}
