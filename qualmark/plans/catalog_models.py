"""Registered queries of the model stages.

What was learned is unknown to SQL, so queries that train return facts that an
untrained or wrongly kept model fails: on planted rows (each label leaves words of
its own in the question) the dev metric must beat always naming the larger class,
and the kept pass must be the argmax found by a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import labels as lb
from ..operators import metrics, ml, prompts, sampling
from ..session import materialize, scratch_path
from ..sources import standins, views
from . import catalog as C
from . import jobs, rounds
from . import sqlviews as V
from .registry import query

def qa_columns():
    return F.col("question"), F.col("answer"), F.col("passage")


# ---- V6: splits by passage -----------------------------------------------------

def grouped_sql(view: str, percent: int, label: str = "error_label") -> str:
    """CTE ``side`` (doc_id, split) of ``grouped_split`` over a view with doc_id."""
    return f"""sg AS (SELECT doc_id, 'g' || doc_id AS g, count(*) AS n, coalesce(min({label}), '') AS l FROM {view} GROUP BY doc_id)
, sh AS (SELECT *, {V.md5_u32(vocab.SPLIT_SEED, 'g')} AS h FROM sg)
, st AS (SELECT l, sum(n) AS ln FROM sh GROUP BY l)
, sq AS (SELECT l, CAST(floor(ln * {percent} / 100) AS BIGINT) AS part, row_number() OVER (ORDER BY ln * {percent} % 100 DESC, l) AS r,
                ceil(sum(ln) OVER () * {percent} / 100) AS want FROM st)
, su AS (SELECT l, part + CASE WHEN r <= want - (SELECT sum(part) FROM sq) THEN 1 ELSE 0 END AS quota FROM sq)
, side AS (SELECT doc_id, CASE WHEN 2 * sum(n) OVER (PARTITION BY l ORDER BY h, g) - n <= 2 * quota THEN 'dev' ELSE 'train' END AS split
           FROM sh JOIN su USING (l))
"""


@query("grouped_split", C.SEED_SQL.rstrip() + ", " + grouped_sql("seed", vocab.IDENTIFIER_DEV_SHARE) +
       "SELECT item_id, split FROM seed JOIN side USING (doc_id)")
def q_grouped_split(spark, sf_dir):
    """Whole passages on one side, sizes by label."""
    return sampling.grouped_split(C.seed_view(spark, sf_dir)).select("item_id", "split")


@query("given_dev_split", C.SEED_SQL + """SELECT item_id, 'dev' AS split FROM seed WHERE item_id % 5 = 0
UNION ALL SELECT item_id, 'train' FROM seed WHERE item_id % 5 <> 0 AND doc_id NOT IN (SELECT doc_id FROM seed WHERE item_id % 5 = 0)""")
def q_given_dev_split(spark, sf_dir):
    """A dev table given by the caller; its passages leave the training rows."""
    s = C.seed_view(spark, sf_dir)
    return sampling.given_dev_split(s.filter("item_id % 5 <> 0"), s.filter("item_id % 5 = 0")).select("item_id", "split")


# ---- L5: thresholds per label ----------------------------------------------------

@query("best_thresholds", C.PRED_SQL.rstrip() + f""", cell AS (
  SELECT i, probs[i + 1] AS p, CAST(list_contains(true_labels, {V.VOCAB}[i + 1]) AS INTEGER) AS y FROM pr, range(0, {len(vocab.LABELS)}) t(i))
, bins AS (SELECT i, CAST(ceil(p * 1000) AS INTEGER) AS b, count(*) AS n, sum(y) AS pos FROM cell GROUP BY ALL)
, cut AS (SELECT i, k, sum(pos) FILTER (WHERE b > k) AS tp, sum(n) FILTER (WHERE b > k) AS found, sum(pos) AS support
          FROM bins, range(0, 1000) c(k) GROUP BY i, k)
, f AS (SELECT i, k, support, CASE WHEN found + support > 0 THEN 2.0 * tp / (found + support) ELSE 0 END AS f1 FROM cut)
, best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY coalesce(f1, 0) DESC, k) AS r FROM f)
SELECT {V.VOCAB}[i + 1] AS label, k / 1000.0 AS threshold, round(coalesce(f1, 0), 6) AS f1, CAST(support AS BIGINT) AS support
FROM best WHERE r = 1""")
def q_best_thresholds(spark, sf_dir):
    """The best of a thousand cutoffs for each label, from one histogram."""
    x = views.logits(spark, sf_dir).select(lb.sigmoid(F.col("logits")).alias("probs"),
                                           lb.binarize(F.col("true_labels")).alias("y_true"))
    return metrics.best_thresholds(x).withColumn("threshold", F.round("threshold", 3))


# ---- planted rows ------------------------------------------------------------------

PLANTED = (("Vague",), ("Vague", "Off Topic"), ("No Error",))
PLANTED_WORDS = 32
PLANTED_SHARE = 20


def _planted_words(words: str, n: int = PLANTED_WORDS):
    """Words of its own that a label (or verdict) leaves in a text."""
    return " ".join(f"{words.replace(' ', '').lower()}{i}" for i in range(n))


def planted_rows(spark, sf_dir):
    """QA rows with planted labels by item_id, split by passage: item_id, doc_id,
    passage, question, answer, error_label, labels, text, split."""
    kind = (F.col("item_id") / 2).cast("long") % len(PLANTED)

    def by_kind(of):
        return F.element_at(F.array(*[of(names) for names in PLANTED]), kind.cast("int") + 1)

    x = C.qa_view(spark, sf_dir).select("item_id", "doc_id", "passage", "question", "answer")
    x = x.withColumn("error_label", by_kind(lambda n: F.lit("; ".join(n)))).withColumn(
        "labels", by_kind(lambda n: F.array(*map(F.lit, n)))).withColumn("question", F.concat(
            "question", F.lit(" "), by_kind(lambda n: F.lit(" ".join(map(_planted_words, n))))))
    x = x.withColumn("text", prompts.identifier_text(*qa_columns()))
    return materialize(sampling.grouped_split(x, dev_percent=PLANTED_SHARE), "planted-rows")


PLANT_SQL = V.with_views(V.QA) + f""", plant AS (SELECT qa.*, {V.list_lit("; ".join(n) for n in PLANTED)}[item_id // 2 % {len(PLANTED)} + 1] AS error_label FROM qa)
, """ + grouped_sql("plant", PLANTED_SHARE)


def planted_verdicts(spark, sf_dir):
    """QA rows with a verdict on their labels that words in the question betray."""
    x = C.qa_view(spark, sf_dir).select("item_id", "doc_id", "passage", "question", "answer")
    label = ((F.col("item_id") / 2).cast("long") % 5 < 2).cast("int")
    x = x.withColumn("label", label).withColumn("pred_error", F.lit("Vague")).withColumn("question", F.concat(
        "question", F.lit(" "), F.when(F.col("label") == 1, _planted_words("agreed")).otherwise(_planted_words("denied"))))
    x = x.withColumn("text", prompts.verifier_text(F.col("pred_error"), *qa_columns())).withColumn("side", F.col("label").cast("string"))
    return materialize(sampling.grouped_split(x, label="side", dev_percent=PLANTED_SHARE), "planted-verdicts")


VERDICT_SQL = V.with_views(V.QA) + """, plant AS (SELECT qa.*, CAST(item_id // 2 % 5 < 2 AS INTEGER) AS label FROM qa)
, """ + grouped_sql("plant", PLANTED_SHARE, "CAST(label AS VARCHAR)")


def sides(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'dev'")


def trained_identifier(spark, sf_dir):
    d = planted_rows(spark, sf_dir)
    return ml.train_identifier(*sides(d)), d


def _larger_class_f1(rows, y: str = "y"):
    """Micro-F1 of always naming the most frequent label set of the rows."""
    top = rows.groupBy(y).count().orderBy(F.desc("count"), y).select(y).limit(1).scalar()
    return metrics.multilabel_metrics(rows.select(F.col(y).alias("y_true"), top.alias("y_pred"))).select("micro_f1")


def _learned(predicted):
    """Whether ``pred_error`` beats the larger class: a scalar of the query."""
    p = predicted.select(lb.binarize(F.col("labels")).alias("y"),
                         lb.binarize(lb.parse_labels(F.col("pred_error"))).alias("y_pred"))
    got = metrics.multilabel_metrics(p.select(F.col("y").alias("y_true"), "y_pred")).select("micro_f1").scalar()
    return got > _larger_class_f1(p).scalar()


def _facts(predicted, *columns):
    """Per row: probabilities in [0, 1], the label string their decoding; and
    whether the whole beats the larger class."""
    p = F.array(*[F.col(f"`{name}_prob`") for name in vocab.LABELS])
    in_range = F.forall(p, lambda x: (x >= 0) & (x <= 1))
    decoded = lb.decode(lb.above(p, lb.thresholds(None))) == F.col("pred_error")
    return predicted.select(*columns, in_range.alias("in_range"), decoded.alias("decoded"),
                            _learned(predicted).alias("learned"))


# ---- M1, M2 ----------------------------------------------------------------------------

@query("train_identifier", PLANT_SQL + """SELECT item_id, error_label, true AS in_range, true AS decoded, true AS learned
FROM plant JOIN side USING (doc_id) WHERE split = 'dev'""")
def q_train_identifier(spark, sf_dir):
    """Dev rows under a freshly trained identifier."""
    m, d = trained_identifier(spark, sf_dir)
    dev = ml.identify_errors(m, sides(d)[1].select("item_id", "text", "error_label", "labels"), need_prob=True)
    return _facts(materialize(dev, "dev-predictions"), "item_id", "error_label")


@query("identify_errors", PLANT_SQL + "SELECT item_id, true AS in_range, true AS decoded, true AS learned FROM plant")
def q_identify_errors(spark, sf_dir):
    m, d = trained_identifier(spark, sf_dir)
    out = ml.identify_errors(m, d.select("item_id", "text", "labels"), need_prob=True)
    return _facts(materialize(out, "predictions"), "item_id")


@query("identify_single", V.with_views(V.QA) + "SELECT item_id, true AS same FROM qa")
def q_identify_single(spark, sf_dir):
    """The scorer of one text against the batch job, on every item."""
    m, d = trained_identifier(spark, sf_dir)
    model = m.model

    @F.udf("boolean")
    def same(text, logits):
        return bool(max(abs(a - b) for a, b in zip(model.score_text(text), logits)) < 1e-9)

    return m.logits(d.select("item_id", "text")).select("item_id", same("text", "logits").alias("same"))


@query("identifier_report", PLANT_SQL + f"""
, lab AS (SELECT split, unnest(string_split(error_label, '; ')) AS label FROM plant JOIN side USING (doc_id))
, per AS (SELECT split, label, count(*) AS n FROM lab GROUP BY split, label)
, names AS (SELECT split, label FROM (SELECT DISTINCT split FROM side), (SELECT unnest({V.VOCAB}) AS label))
SELECT names.split, names.label, CAST(coalesce(n, 0) AS BIGINT) AS support, true AS in_range FROM names LEFT JOIN per USING (split, label)
UNION ALL SELECT split, avg, CAST(sum(n) AS BIGINT), true FROM per, (SELECT unnest(['micro avg', 'macro avg', 'weighted avg', 'samples avg']) AS avg) GROUP BY split, avg""")
def q_identifier_report(spark, sf_dir):
    """The report on the training rows beside that on the dev rows."""
    m, d = trained_identifier(spark, sf_dir)
    pred = materialize(m.logits(d.select("split", "text", lb.binarize(F.col("labels")).alias("y_true"))).select(
        "split", "y_true", lb.above(lb.sigmoid(F.col("logits")), lb.thresholds(None)).alias("y_pred")), "predictions")
    out = None
    for side in ("train", "dev"):
        r = metrics.multilabel_report(pred.filter(F.col("split") == side))
        scores = F.array(*[F.col(c) for c, kind in r.dtypes if kind == "double"])
        r = r.select(F.lit(side).alias("split"), F.col(r.columns[0]).alias("label"), F.col("support").cast("long"),
                     F.forall(scores, lambda x: (x >= 0) & (x <= 1)).alias("in_range"))
        out = r if out is None else out.unionByName(r)
    return out


@query("evaluate_with_identifier", V.with_views(V.QA, V.QA_DIM) +
       "SELECT item_id, dimension, 'rule' AS model, true AS graded FROM qad")
def q_evaluate_with_identifier(spark, sf_dir):
    """Error-aware evaluation with labels from a freshly trained identifier:
    every row and dimension gets a grade."""
    m, d = trained_identifier(spark, sf_dir)
    qa = d.select("item_id", "passage", "question", "answer")
    out = jobs.evaluate(qa, C.templates_df(spark), standins.length_rule_evaluator, "rule", identifier=m)
    return out.select("item_id", "dimension", "model", F.col("score").between(1, 3).alias("graded"))


# ---- M3, M4 ----------------------------------------------------------------------------

def _verdict_facts(judged, *columns):
    p = F.col("positive_prob")
    t, v = F.col("label") == 1, F.col("verify_label") == 1
    f1 = metrics.f1_from_counts(F.count_if(t & v), F.count_if(~t & v), F.count_if(t & ~v))
    always = metrics.f1_from_counts(F.count_if(t), F.count_if(~t), F.lit(0))
    right = F.avg((t == v).cast("double")) > F.greatest(F.avg(t.cast("double")), F.avg((~t).cast("double")))
    learned = judged.agg(((f1 > always) & right).alias("learned")).scalar()
    return judged.select(*columns, ((p >= 0) & (p <= 1)).alias("in_range"), ((p > 0.5) == v).alias("decoded"),
                         learned.alias("learned"))


@query("train_verifier", VERDICT_SQL + """SELECT item_id, label, true AS in_range, true AS decoded, true AS learned
FROM plant JOIN side USING (doc_id) WHERE split = 'dev'""")
def q_train_verifier(spark, sf_dir):
    """Dev rows under a freshly trained verifier."""
    train, dev = sides(planted_verdicts(spark, sf_dir))
    out = ml.verify_labels(ml.train_verifier(train, dev), dev.select("item_id", "text", "label"))
    return _verdict_facts(materialize(out, "verdicts"), "item_id", "label")


@query("verify_labels", VERDICT_SQL +
       "SELECT item_id, 'Vague' AS pred_error, true AS in_range, true AS decoded, true AS learned FROM plant")
def q_verify_labels(spark, sf_dir):
    d = planted_verdicts(spark, sf_dir)
    out = ml.verify_labels(ml.train_verifier(*sides(d)), d.select("item_id", "pred_error", "text", "label"))
    return _verdict_facts(materialize(out, "verdicts"), "item_id", "pred_error")


# ---- M5: the best pass, the best candidate ------------------------------------------------

def noisy_rows(spark, sf_dir):
    """Planted rows of which two in five training rows bear a wrong label, so that
    later passes learn the noise."""
    d = planted_rows(spark, sf_dir)
    wrong = (F.col("split") == "train") & (F.pmod(F.col("item_id"), F.lit(5)) < 2)
    return d.withColumn("labels", F.when(wrong, F.array(F.lit("Grammar Error"))).otherwise(F.col("labels")))


def kept_by_sql(spark, history):
    """The first pass with the greatest score, by a plain aggregate."""
    table = spark.createDataFrame(history, "pass int, score double")
    return table.agg(F.min_by("pass", F.struct(-F.col("score"), "pass"))).scalar(), table


@query("training_passes", "SELECT true AS kept_is_argmax, true AS stopped, true AS restored FROM (SELECT 1) "
       "WHERE EXISTS (SELECT 1 FROM conversations)")
def q_training_passes(spark, sf_dir):
    """The passes of a training on noise: the kept one is the argmax, three passes
    without gain end it (or the limit), and the returned model scores as the kept
    pass did."""
    from ..operators import passes
    train, dev = sides(noisy_rows(spark, sf_dir))
    m = ml.train_identifier(train, dev)
    best, table = kept_by_sql(spark, m.history)
    y = lb.binarize(F.col("labels"))
    again = m.logits(dev.select("text", y.alias("y"))).select(
        F.col("y").alias("y_true"), lb.above(lb.sigmoid(F.col("logits")), lb.thresholds(None)).alias("y_pred"))
    f1 = metrics.multilabel_metrics(again).select("micro_f1").scalar()
    last = F.max("pass")
    return table.agg((F.first(best) == m.kept).alias("kept_is_argmax"),
                     ((last - m.kept == passes.PATIENCE) | (last == passes.MAX_PASSES)).alias("stopped"),
                     (F.first(f1) == F.max("score")).alias("restored"))


def _candidate_facts(spark, chosen, scores, f1_again):
    """Facts of a choice between candidates: (reg_param, kept pass, score)."""
    table = spark.createDataFrame([(r, float(s)) for r, _, s in scores], "reg_param double, score double")
    top = table.agg(F.max("score")).scalar()
    return table.select("reg_param", F.col("score").between(0, 1).alias("in_range"),
                        (F.lit(float(max(s for _, s in chosen.history))) == top).alias("chosen_is_best"),
                        (f1_again == top).alias("chosen_scores_best"))


@query("select_model", "SELECT CAST(r AS DOUBLE) AS reg_param, true AS in_range, true AS chosen_is_best, "
       "true AS chosen_scores_best FROM (VALUES (0.0), (0.01), (0.1)) t(r) WHERE EXISTS (SELECT 1 FROM conversations)")
def q_select_model(spark, sf_dir):
    """Verifier regularisation by dev F1; the chosen model is scored anew."""
    train, dev = sides(planted_verdicts(spark, sf_dir))
    best, scores = ml.select_model(train, dev)
    v, t = F.col("verify_label") == 1, F.col("label") == 1
    again = ml.verify_labels(best, dev.select("text", "label")).agg(F.round(metrics.f1_from_counts(
        F.count_if(t & v), F.count_if(~t & v), F.count_if(t & ~v)), 6)).scalar()
    return _candidate_facts(spark, best, scores, again)


@query("select_identifier", "SELECT CAST(r AS DOUBLE) AS reg_param, true AS in_range, true AS chosen_is_best, "
       "true AS chosen_scores_best FROM (VALUES (0.0), (0.01)) t(r) WHERE EXISTS (SELECT 1 FROM documents)")
def q_select_identifier(spark, sf_dir):
    """Identifier regularisation by dev micro-F1; the chosen model is scored anew."""
    train, dev = sides(noisy_rows(spark, sf_dir))
    best, scores = ml.select_identifier(train, dev)
    again = best.logits(dev.select("text", lb.binarize(F.col("labels")).alias("y_true"))).select(
        "y_true", lb.above(lb.sigmoid(F.col("logits")), lb.thresholds(None)).alias("y_pred"))
    return _candidate_facts(spark, best, scores, metrics.multilabel_metrics(again).select("micro_f1").scalar())


# ---- M6: self-training ----------------------------------------------------------------------

ROUND_COLUMNS = ("item_id", "passage", "question", "answer", "source", "error_label")


def round_inputs(spark, sf_dir):
    train = C.seed_view(spark, sf_dir).select(*ROUND_COLUMNS)
    return C.qa_view(spark, sf_dir).select(*ROUND_COLUMNS[:-1]), train


#: Words of a label or verdict in a round: with more of them long passages do not hide them.
ROUND_WORDS = 128
AGREED, DENIED = ("agreed", "accepted"), ("denied", "rejected")


def _round_words(*names: str) -> str:
    return " ".join(_planted_words(n, ROUND_WORDS) for n in names)


def planted_round(rows):
    """``rows`` with the words of a label and of a verdict in the question, both by
    item_id: the columns of a round, and the verdict as ``label``."""
    kind = (F.col("item_id") / 2).cast("long")
    agreed = kind % 5 < 2

    def by_kind(of):
        return F.element_at(F.array(*[F.lit(of(names)) for names in PLANTED]), (kind % len(PLANTED)).cast("int") + 1)

    words = (by_kind(lambda n: _round_words(*n)),
             F.when(agreed, _round_words(*AGREED)).otherwise(_round_words(*DENIED)))
    x = rows.withColumn("question", F.concat("question", F.lit(" "), words[0], F.lit(" "), words[1])).withColumn(
        "error_label", by_kind("; ".join))
    return x.select(*ROUND_COLUMNS, agreed.cast("int").alias("label"))


def trained_round(spark, sf_dir):
    """(identifier, verifier, training rows): both models freshly trained on all
    labelled QA rows, planted."""
    d = materialize(planted_round(C.seed_view(spark, sf_dir)), "round-rows")
    named = d.withColumn("text", prompts.identifier_text(*qa_columns())).withColumn(
        "labels", lb.parse_labels(F.col("error_label")))
    judged = d.withColumn("text", prompts.verifier_text(F.col("error_label"), *qa_columns()))
    return ml.train_identifier(named), ml.train_verifier(judged), d.select(*ROUND_COLUMNS)


def _planted_sql(view: str) -> str:
    kinds = V.list_lit(_round_words(*n) for n in PLANTED)
    return f"""SELECT item_id, passage, question || ' ' || {kinds}[item_id // 2 % {len(PLANTED)} + 1] || ' ' ||
    CASE WHEN item_id // 2 % 5 < 2 THEN {V.lit(_round_words(*AGREED))} ELSE {V.lit(_round_words(*DENIED))} END AS question,
  answer, source, {V.list_lit("; ".join(n) for n in PLANTED)}[item_id // 2 % {len(PLANTED)} + 1] AS error_label FROM {view}"""


@query("self_train_round", C.SEED_SQL.rstrip() + f"""
{_planted_sql('seed')}
UNION ALL {_planted_sql('qa')} WHERE item_id // 2 % 5 < 2 AND item_id NOT IN (SELECT item_id FROM seed)""")
def q_self_train_round(spark, sf_dir):
    """One whole round: both models are trained on the labelled rows, then label
    and judge the rest of the pool. The planted words are plain enough that the
    SQL names what well trained models accept."""
    ident, ver, train = trained_round(spark, sf_dir)
    pool = planted_round(C.qa_view(spark, sf_dir)).select(*ROUND_COLUMNS[:-1])
    return jobs.self_train_round(ident, ver, pool, train)


@query("self_train_accept", V.with_views(V.QA, V.LAB, V.SEED) + """
SELECT item_id, error_label FROM seed
UNION ALL SELECT item_id, 'Vague; Off Topic' FROM qa WHERE item_id % 3 = 1 AND item_id NOT IN (SELECT item_id FROM seed)""")
def q_self_train_accept(spark, sf_dir):
    """Filter and union of a self-training round with rules for models."""
    train_set = C.seed_view(spark, sf_dir).select("item_id", "error_label")
    pool = C.qa_view(spark, sf_dir).select("item_id").join(train_set.select("item_id"), "item_id", "left_anti")
    verified = pool.select("item_id", F.lit("Vague; Off Topic").alias("pred_error"),
                           (F.col("item_id") % 3 == 1).cast("int").alias("verify_label"))
    return jobs.add_accepted(train_set, verified)


#: What a pool row needs in the training set to be accepted: a passage this far away.
STEPS = (1, 2, 3)


def neighbour_judge(k, now, rest):
    """Accepts the rows whose document's neighbour (the round's step below) has a
    training row with the same turn; the round names the label."""
    doc, turn = (F.col("item_id") / 100).cast("long"), F.col("item_id") % 100
    near = now.select(((doc + STEPS[k - 1]) * 100 + turn).alias("item_id"), F.lit(1).alias("verify_label"))
    return rest.join(near, "item_id", "left").withColumn("pred_error", F.lit(vocab.LABELS[k]))


def _rounds_sql() -> str:
    out, now = "", "t0"
    for k, d in enumerate(STEPS, 1):
        out += f""", t{k} AS (SELECT * FROM {now} UNION ALL SELECT qa.item_id, {V.lit(vocab.LABELS[k])}, {k} FROM qa
  WHERE item_id NOT IN (SELECT item_id FROM {now}) AND item_id - {100 * d} IN (SELECT item_id FROM {now}))
"""
        now = f"t{k}"
    return out + f"SELECT item_id, error_label, round FROM {now}"


@query("self_train_rounds", C.SEED_SQL.rstrip() + """, t0 AS (SELECT item_id, error_label, 0 AS round FROM seed WHERE doc_id % 4 = 1)
""" + _rounds_sql())
def q_self_train_rounds(spark, sf_dir):
    """Three rounds with a durable state and a rule for a judge; the run is cut
    off behind the first round and goes on from its state."""
    pool, train = round_inputs(spark, sf_dir)
    train = train.filter("cast(item_id / 100 as long) % 4 = 1").select("item_id", "error_label")
    state = scratch_path(spark, "rounds")
    rounds.self_train(pool.select("item_id"), train, neighbour_judge, state, max_rounds=1)
    return rounds.self_train(pool.select("item_id"), train, neighbour_judge, state, max_rounds=len(STEPS))
