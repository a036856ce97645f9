"""Invariants of the composite jobs on the small test tables."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from qualmark import vocab
from qualmark.operators import voting
from qualmark.plans import catalog, jobs
from qualmark.sources import standins

needs_data = pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data missing")


@needs_data
def test_training_set_rows_pass_the_vote(spark):
    out = catalog.QUERIES_FOR_TESTS["build_training_set"](spark, SF0001)
    cols = [f"check-{r}" for r in vocab.REVIEWERS]
    assert set(cols) <= set(out.columns)
    x = voting.required_thresholds(out, by="threshold", threshold=0.5,
                                   low_precision=vocab.LOW_PRECISION_LABELS)
    x = x.withColumn("v", voting.count_votes(cols, F.col("required_thres")))
    assert x.filter(F.col("v") < F.col("required_vote")).count() == 0
    # accepted generated rows carry the generated source tag
    assert out.filter(~F.col("source").endswith("_GPT-4")).count() == 0


@needs_data
def test_evaluate_direct_mode(spark):
    qa = catalog.qa_view(spark, SF0001).select("item_id", "passage", "question", "answer")
    def fn(batch):
        # direct prompts carry no checker evidence section
        assert all("Checker labels" not in m[-1]["content"] for m in batch)
        return standins.length_rule_evaluator(batch)

    out = jobs.evaluate(qa, catalog.templates_df(spark), fn, "rule", error_aware=False,
                        dimensions=["fluency", "clarity"])
    rows = out.collect()
    assert len(rows) == 2 * qa.count()
    assert {r.dimension for r in rows} == {"fluency", "clarity"}
    assert all(1 <= r.score <= 3 for r in rows)


@needs_data
def test_self_train_round_is_whole(spark):
    """A round with trained models against a plain filter and union of their predictions."""
    from qualmark.operators import ml, prompts
    from qualmark.plans import catalog_models as M
    ident = ml.train_identifier(M.planted_rows(spark, SF0001))
    ver = ml.train_verifier(M.planted_verdicts(spark, SF0001))
    pool, train = M.round_inputs(spark, SF0001)
    got = [(r.item_id, r.error_label) for r in jobs.self_train_round(ident, ver, pool, train).collect()]

    seed = [(r.item_id, r.error_label) for r in train.collect()]
    qa = (F.col("question"), F.col("answer"), F.col("passage"))
    pred = ml.identify_errors(ident, pool.withColumn("text", prompts.identifier_text(*qa))) \
        .withColumn("text", prompts.verifier_text(F.col("pred_error"), *qa))
    seen = {i for i, _ in seed}
    judged = [r for r in ml.verify_labels(ver, pred).collect() if r.item_id not in seen]
    assert judged
    assert sorted(got, key=repr) == sorted(seed + [(r.item_id, r.pred_error) for r in judged if r.verify_label == 1], key=repr)


@needs_data
def test_registered_round_trains_both_models(spark, monkeypatch):
    """The query's round is judged by models trained on its training rows."""
    from qualmark.operators import ml
    from qualmark.plans import catalog_models as M
    trained, rounds = {}, []
    for name in ("train_identifier", "train_verifier"):
        def train(rows, *args, _name=name, _train=getattr(ml, name), **options):
            trained[_name] = (_train(rows, *args, **options), rows.count())
            return trained[_name][0]
        monkeypatch.setattr(ml, name, train)
    whole = jobs.self_train_round
    monkeypatch.setattr(jobs, "self_train_round", lambda *args: rounds.append(args) or whole(*args))
    got = [r.item_id for r in M.q_self_train_round(spark, SF0001).collect()]
    seeds = [r.item_id for r in catalog.seed_view(spark, SF0001).select("item_id").collect()]
    assert {n for _, n in trained.values()} == {len(seeds)} and len(trained) == 2
    assert [m for m in rounds[0][:2]] == [trained["train_identifier"][0], trained["train_verifier"][0]]
    assert all(m.model.weights.any() for m, _ in trained.values())
    assert set(seeds) < set(got) and len(got) == len(set(got))
