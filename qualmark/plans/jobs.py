"""User-level jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..operators import metrics, rows
from ..sources import views


def meta_evaluate(responses: DataFrame, ratings: DataFrame,
                  keys=("dimension", "model")) -> DataFrame:
    """Model scores vs human ratings: parse -> pair -> drop 999 -> Pearson, with
    ``n_unmatched``: the dimension's ratings that have no reply.

    ``responses``: item_id, dimension, model, response.
    ``ratings``: item_id, dimension, rating.
    """
    scored = rows.with_score(responses.select("item_id", "dimension", "model", "response"))
    paired = rows.pair_rating_pred(ratings.select("item_id", "dimension", "rating"),
                                   scored.drop("response"))
    per = metrics.pearson_by_group(paired, list(keys), "rating", "score",
                                   valid=F.col("score") != vocab.NO_SCORE)
    lost = rows.count_unmatched(ratings.select("item_id", "dimension"), responses)
    return per.join(lost.select("dimension", "n_unmatched"), "dimension")


def meta_evaluate_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``meta_evaluate`` on the V-RESP view (rating on the response row)."""
    r = views.responses(spark, sf_dir)
    return metrics.pearson_by_group(rows.with_score(r), ["dimension", "model"], "rating", "score",
                                    valid=F.col("score") != vocab.NO_SCORE)


def evaluate(qa: DataFrame, templates: DataFrame, complete_fn, model_name: str,
             error_aware: bool = True, dimensions=None, label_col: str = "error_label",
             identifier=None, model_type: str = "roberta", thinking: str | None = None,
             thresholds=None, **calls) -> DataFrame:
    """Rows -> (error-aware or direct) prompts per dimension -> evaluator
    replies -> scores. With ``error_aware``, labels come from ``label_col``
    (a recorded identifier run) or, if ``identifier`` is given, from that
    model (with its ``thresholds``) applied to the rows first. Scores are read
    behind the reasoning; ``thinking`` names a column that keeps it. ``calls`` go
    to ``complete_batch``."""
    from ..operators import completion, ml, prompts
    dims = dimensions or vocab.DIMENSIONS
    if error_aware and identifier is not None:
        text = prompts.identifier_text(F.col("question"), F.col("answer"), F.col("passage"), model_type)
        qa = ml.identify_errors(identifier, qa.withColumn("text", text), thresholds, label_col).drop("text")
    cols = ["item_id", "passage", "question", "answer"] + ([label_col] if error_aware else [])
    msgs = prompts.render_batch(qa.select(*cols), templates, error_aware, dims, label_col)
    replies = completion.complete_batch(msgs.select("item_id", "dimension", "messages"), complete_fn, **calls)
    return rows.with_score(replies.withColumn("model", F.lit(model_name)), thinking=thinking)


def compare_modes(scored: DataFrame, ratings: DataFrame | None = None,
                  modes=("vanilla", "error")) -> DataFrame:
    """Pearson per (dimension, model) for each prompting mode side by side.

    ``scored``: item_id, dimension, model, mode, score, and rating unless
    ``ratings`` (item_id, dimension, rating) are to be joined."""
    paired = scored if ratings is None else rows.pair_rating_pred(ratings, scored)
    per = metrics.pearson_by_group(paired, ["mode", "dimension", "model"], "rating", "score",
                                   valid=F.col("score") != vocab.NO_SCORE)
    wide = per.groupBy("dimension", "model").pivot("mode", list(modes)).agg(
        F.first("n").alias("n"), F.first("pearson_r").alias("r"))
    out = [F.col("dimension"), F.col("model")]
    for m in modes:
        out += [F.col(f"{m}_n").alias(f"{m}_n"), F.col(f"{m}_r").alias(f"{m}_r")]
    return wide.select(*out)


def self_train_round(identifier, verifier, pool: DataFrame, train_set: DataFrame,
                     text_model_type: str = "roberta") -> DataFrame:
    """Predict labels for the pool without the training rows, keep rows the
    verifier accepts, and add them to the training set (its columns).
    ``rounds.self_train`` repeats this with a durable state."""
    from .rounds import with_models
    rest = pool.join(train_set.select("item_id"), "item_id", "left_anti")
    return add_accepted(train_set, with_models(identifier, verifier, rest, text_model_type))


def add_accepted(train_set: DataFrame, verified: DataFrame) -> DataFrame:
    """The training set and the verified rows the verifier accepts, with their
    predicted label."""
    ok = verified.filter(F.col("verify_label") == 1)
    return train_set.unionByName(
        ok.withColumn("error_label", F.col("pred_error")).select(*train_set.columns))


def build_training_set(candidates: DataFrame, seeds: DataFrame, templates: DataFrame,
                       generate_for, review_fns: dict, difficulty=None, importance=None,
                       low_precision=(), threshold: float = 0.8, by: str = "threshold",
                       attempts: int = 3, seed: int = 42) -> DataFrame:
    """Label statistics -> weights -> one target label per candidate ->
    few-shot example -> generation prompt -> generator replies (up to
    ``attempts``) -> first valid reply -> review prompt -> reviewer replies
    -> confidences -> votes -> accepted training rows.

    ``candidates``: item_id, passage, answer, source. ``seeds``: item_id,
    passage, answer, question, error_label. ``generate_for``: number of the
    attempt -> batch function. ``review_fns``: reviewer name -> batch function.
    Each attempt calls the generator only for the items still without an
    accepted reply, with the same prompt, and is written, so a recomputed stage
    never asks again."""
    from ..functions import parse, text as tx
    from ..operators import completion, distribution, generation, prompts, sampling, voting
    from ..session import materialize
    # seeds feed the weights, the per-label slots and the example join:
    # write them once (a table prunes columns on each read) instead of
    # recomputing their lineage each time
    seeds = materialize(seeds, "seeds")
    w = distribution.label_weights(distribution.label_distribution(seeds, known_only=True), difficulty,
                                   importance, seed=seed)
    drawn = sampling.weighted_label_sample(candidates, w, seed)
    shots = sampling.attach_few_shot(drawn, seeds.select("item_id", "passage", "answer",
                                                         "question", "error_label"), seed=seed)
    gp = prompts.render_generation_prompt(shots, templates)
    gp = gp.withColumn("messages", tx.build_messages(vocab.SYSTEM_GENERATOR, F.col("prompt")))
    todo = materialize(gp.select("item_id", "passage", "answer", "source", "target_labels", "messages"),
                       "generation-requests")
    acc = None
    for attempt in range(1, attempts + 1):
        replies = completion.complete_batch(todo.withColumn("attempt", F.lit(attempt)), generate_for(attempt))
        got = materialize(generation.make_training_row(generation.accepted(replies)), "accepted")
        acc = got if acc is None else acc.unionByName(got)
        todo = todo.join(got.select("item_id"), "item_id", "left_anti")
    rp = prompts.render_review_prompt(acc, templates)
    rp = rp.withColumn("messages", tx.build_messages(vocab.SYSTEM_REVIEWER, F.col("prompt")))
    reviews = None
    for name, fn in review_fns.items():
        r = completion.complete_batch(rp.select("item_id", "messages"), fn)
        r = r.select("item_id", F.lit(name).alias("reviewer"),
                     parse.parse_confidence(F.col("response")).alias("confidence"))
        reviews = r if reviews is None else reviews.unionByName(r)
    merged = voting.merge_reviews(acc, reviews, list(review_fns))
    return voting.vote_filter(merged, [f"check-{n}" for n in review_fns], "vote", threshold,
                              low_precision, by=by)


def resume_scoring(requests: DataFrame, sink_dir: str, complete_fn,
                   keys=("item_id", "dimension", "model"), waves: int = 1, **calls) -> DataFrame:
    """Score the requests without a reply in ``sink_dir`` and append them.

    ``requests``: keys + ``messages``. The sink holds keys, ``response``,
    ``score``, ``failure`` and ``run``. A row whose calls all failed is kept with
    its reason and asked again by the next run; a finished run adds nothing. The
    pending rows are dealt by key into ``waves``, each appended on its own, so a
    killed run repeats the calls of one wave at most; ``calls`` go to
    ``complete_batch``. Returns the sink with one row per key: a reply before a
    failure, then the latest run."""
    from ..operators import completion
    from ..session import discard, materialize, path_exists
    spark = requests.sparkSession
    run, pending = 1, requests
    if path_exists(spark, sink_dir):
        sink = spark.read.parquet(sink_dir)
        run = (sink.agg(F.max("run")).first()[0] or 0) + 1
        pending = rows.pending_rows(requests, sink.filter(F.col("response") != ""), list(keys))
    pending = pending.select(*keys, "messages")
    if waves > 1:  # read once, not once a wave
        pending = materialize(pending.withColumn("_wave", F.pmod(F.xxhash64(*keys), F.lit(waves))), "pending")
    for k in range(waves):
        part = pending.filter(F.col("_wave") == k).drop("_wave") if waves > 1 else pending
        replies = completion.complete_batch(part, complete_fn, failure_col="failure", **calls)
        rows.with_score(replies).withColumn("run", F.lit(run)).write.mode("append").parquet(sink_dir)
    if waves > 1:
        discard(pending)
    return latest_scores(spark.read.parquet(sink_dir), keys)


def latest_scores(sink: DataFrame, keys) -> DataFrame:
    """One row per key of a resumable sink."""
    order = F.struct(F.col("response") != "", "run")
    fields = [c for c in sink.columns if c not in keys]
    return (sink.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_r"))
            .select(*keys, "_r.*"))
