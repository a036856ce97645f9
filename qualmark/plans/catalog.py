"""Registered queries, grouped like the operator inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import parse
from ..operators import metrics
from ..sources import standins, views
from . import sqlviews as V
from .registry import query


def scored_responses(spark, sf_dir):
    r = views.responses(spark, sf_dir)
    return r.withColumn("score", parse.extract_score(F.col("response")))


# ---- C2 / A4: the flagship --------------------------------------------------

@query("pearson_by_dimension", V.with_views(V.RESP, V.SCORED) + """
SELECT dimension, model, CAST(count(*) AS BIGINT) AS n,
       round(CASE WHEN stddev_pop(rating) * stddev_pop(score) = 0 THEN NULL
                  ELSE covar_pop(rating, score) / (stddev_pop(rating) * stddev_pop(score)) END, 6) AS pearson_r
FROM scored WHERE score <> 999 GROUP BY dimension, model""")
def q_pearson_by_dimension(spark, sf_dir):
    s = scored_responses(spark, sf_dir)
    return metrics.pearson_by_group(s, ["dimension", "model"], "rating", "score",
                                    valid=F.col("score") != vocab.NO_SCORE)


# ---- X: response parsing -------------------------------------------------------

@query("extract_score", V.with_views(V.RESP, V.SCORED) +
       "SELECT item_id, dimension, model, score FROM scored")
def q_extract_score(spark, sf_dir):
    return scored_responses(spark, sf_dir).select("item_id", "dimension", "model", "score")


@query("drop_unparsed", V.with_views(V.RESP, V.SCORED) +
       "SELECT item_id, dimension, model, rating, score FROM scored WHERE score <> 999")
def q_drop_unparsed(spark, sf_dir):
    from ..operators import rows
    return rows.drop_unparsed(scored_responses(spark, sf_dir)).select(
        "item_id", "dimension", "model", "rating", "score")


@query("parse_rate", V.with_views(V.RESP, V.SCORED) + """
SELECT dimension, model, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN score = 999 THEN 1 ELSE 0 END) AS BIGINT) AS n_unparsed,
       round(avg(CASE WHEN score = 999 THEN 1.0 ELSE 0.0 END), 6) AS unparsed_rate
FROM scored GROUP BY dimension, model""")
def q_parse_rate(spark, sf_dir):
    return metrics.parse_rate(scored_responses(spark, sf_dir))


def thinking_responses(spark, sf_dir):
    """V-RESP replies, some wrapped in reasoning with one or two markers."""
    r = views.responses(spark, sf_dir)
    k = F.col("item_id")
    text = (F.when(k % 3 == 0, F.concat(F.lit("plan for "), F.col("dimension"),
                                         F.lit("\n</think>\n\n"), F.col("response")))
            .when(k % 3 == 1, F.concat(F.lit("a</think>b</think>\n"), F.col("response")))
            .otherwise(F.col("response")))
    return r.select("item_id", text.alias("raw"))


THINK_SQL = V.with_views(V.RESP) + r"""
, th AS (
  SELECT item_id, CASE item_id % 3
      WHEN 0 THEN 'plan for ' || dimension || chr(10) || '</think>' || chr(10) || chr(10) || response
      WHEN 1 THEN 'a</think>b</think>' || chr(10) || response
      ELSE response END AS raw FROM resp)
, sp AS (
  SELECT item_id,
    CASE WHEN regexp_matches(raw, '(?s)^(.*)</think>(.*)$') THEN regexp_extract(raw, '(?s)^(.*)</think>(.*)$', 1) ELSE '' END AS r0,
    CASE WHEN regexp_matches(raw, '(?s)^(.*)</think>(.*)$') THEN regexp_extract(raw, '(?s)^(.*)</think>(.*)$', 2) ELSE raw END AS c0
  FROM th)
SELECT item_id, trim(r0, chr(10)) AS reasoning, trim(c0, chr(10)) AS content,
  """ + V.extract_score("trim(c0, chr(10))") + " AS score FROM sp"


@query("split_thinking", THINK_SQL)
def q_split_thinking(spark, sf_dir):
    from ..functions import parse as P
    t = thinking_responses(spark, sf_dir)
    reasoning, content = P.split_thinking(F.col("raw"))
    return t.select("item_id", reasoning.alias("reasoning"), content.alias("content")) \
        .withColumn("score", P.extract_score(F.col("content")))


GEN_SQL_VIEW = f"""gen AS (
  SELECT doc_id AS item_id,
    CASE doc_id % 5
      WHEN 0 THEN '{{"question": "' || q || '", "error_label": "' || l || '"}}'
      WHEN 1 THEN '```json' || chr(10) || '{{"question": "' || q || '", "error_label": "' || l || '"}}' || chr(10) || '```'
      WHEN 2 THEN '{{''question'': ''' || q || ''', ''error_label'': ''' || l || '''}}'
      WHEN 3 THEN '{{"question": "' || q || '", "error_label": "' || l || '"}}' || CASE WHEN doc_id % 2 = 0 THEN ' Hope this helps!' ELSE ' or ' || '{{"question": "' || q || '", "error_label": "' || l || '"}}' END
      ELSE 'no json here ' || CAST(doc_id AS VARCHAR) END AS response,
    l AS target_label
  FROM (SELECT doc_id, 'What does document ' || CAST(doc_id AS VARCHAR) || ' say about ' || source || '?' AS q,
               {V.label_string('doc_id')} AS l FROM documents))"""


def sql_json_field(text: str, field: str) -> str:
    s = V.ustrip(text)
    stripped = (f"(CASE WHEN starts_with({s}, '```json') THEN regexp_replace(regexp_replace({s}, '^```json', ''), '```$', '') "
                f"WHEN starts_with({s}, '```') THEN (CASE WHEN ends_with(substr({s}, 4), '```') "
                f"THEN substr({s}, 4, length({s}) - 6) ELSE substr({s}, 4) END) ELSE {s} END)")
    dq = f"replace({stripped}, '''', '\"')"
    v1 = f"(CASE WHEN json_valid({stripped}) THEN {stripped} ELSE 'null' END)"
    v2 = f"(CASE WHEN json_valid({dq}) THEN {dq} ELSE 'null' END)"
    return (f"(CASE WHEN json_type({v1}) = 'OBJECT' THEN json_extract_string({v1}, '$.{field}') "
            f"WHEN json_type({v2}) = 'OBJECT' THEN json_extract_string({v2}, '$.{field}') END)")


@query("parse_generated_json", V.with_views(GEN_SQL_VIEW) +
       f"SELECT item_id, {sql_json_field('response', 'question')} AS question, "
       f"{sql_json_field('response', 'error_label')} AS error_label FROM gen")
def q_parse_generated_json(spark, sf_dir):
    from ..functions import parse as P
    g = views.generated(spark, sf_dir)
    j = P.parse_generated_json(F.col("response"))
    return g.select("item_id", j["question"].alias("question"), j["error_label"].alias("error_label"))


REVL_SQL = V.REV + """, revl AS (
  SELECT item_id, r.reviewer AS reviewer,
         CASE WHEN r.v IS NULL THEN 'n/a' ELSE ' ' || printf('%.2f', r.v) || chr(10) END AS response
  FROM (SELECT item_id, unnest([{'reviewer': 'gemini', 'v': "check-gemini"},
                                {'reviewer': 'gpt', 'v': "check-gpt"},
                                {'reviewer': 'claude', 'v': "check-claude"}]) AS r FROM rev))"""


@query("parse_confidence", V.with_views(REVL_SQL) +
       f"SELECT item_id, reviewer, TRY_CAST({V.ustrip('response')} AS DOUBLE) AS confidence FROM revl")
def q_parse_confidence(spark, sf_dir):
    from ..functions import parse as P
    r = views.review_long(spark, sf_dir)
    return r.select("item_id", "reviewer", P.parse_confidence(F.col("response")).alias("confidence"))


# ---- A: metrics ---------------------------------------------------------------

ML_SQL = V.with_views(V.LOGIT) + f""", ml AS (
  SELECT item_id, logits, {V.binarize('true_labels')} AS y_true,
         list_transform({V.sigmoid_list('logits')}, lambda p: CAST(p > 0.5 AS INTEGER)) AS y_pred
  FROM logit)
, cells AS (
  SELECT item_id, i, y_true[i + 1] AS y, y_pred[i + 1] AS p
  FROM ml, range(0, {len(vocab.LABELS)}) t(i))
, per AS (
  SELECT i, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM cells GROUP BY i)
, rowstat AS (
  SELECT item_id, list_sum(list_transform(range(0, {len(vocab.LABELS)}), lambda i: y_true[i + 1] * y_pred[i + 1])) AS inter,
         list_sum(y_true) AS ny, list_sum(y_pred) AS np, CAST(y_true = y_pred AS INTEGER) AS exact FROM ml)
"""


def sql_ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


@query("multilabel_metrics", ML_SQL + f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM rowstat) AS n,
       round((SELECT {sql_ratio('sum(exact)', 'count(*)')} FROM rowstat), 6) AS accuracy,
       round({sql_ratio('sum(tp)', 'sum(tp) + sum(fp)')}, 6) AS micro_precision,
       round({sql_ratio('sum(tp)', 'sum(tp) + sum(fn)')}, 6) AS micro_recall,
       round({sql_ratio('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')}, 6) AS micro_f1,
       round(avg({sql_ratio('2 * tp', '2 * tp + fp + fn')}), 6) AS macro_f1
FROM per""")
def q_multilabel_metrics(spark, sf_dir):
    return metrics.multilabel_metrics(prediction_table(spark, sf_dir))


def prediction_table(spark, sf_dir):
    from ..functions import labels as lb
    lg = views.logits(spark, sf_dir)
    return lg.select("item_id", "logits", lb.binarize(F.col("true_labels")).alias("y_true"),
                     lb.above(lb.sigmoid(F.col("logits")), lb.thresholds(None)).alias("y_pred"))


REPORT_ROWS = "(" + " UNION ALL ".join(
    f"SELECT {i} AS i, {V.lit(lab)} AS name" for i, lab in enumerate(vocab.LABELS)) + ")"


@query("multilabel_report", ML_SQL + f""", lr AS (
  SELECT n.name AS row_label, {sql_ratio('tp', 'tp + fp')} AS prec, {sql_ratio('tp', 'tp + fn')} AS rec,
         {sql_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, CAST(tp + fn AS BIGINT) AS support
  FROM per JOIN {REPORT_ROWS} n ON n.i = per.i)
, allrows AS (
  SELECT row_label, prec, rec, f1, support FROM lr
  UNION ALL
  SELECT 'micro avg', {sql_ratio('sum(tp)', 'sum(tp) + sum(fp)')}, {sql_ratio('sum(tp)', 'sum(tp) + sum(fn)')},
         {sql_ratio('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')}, CAST(sum(tp + fn) AS BIGINT) FROM per
  UNION ALL
  SELECT 'macro avg', avg(prec), avg(rec), avg(f1), CAST(sum(support) AS BIGINT) FROM lr
  UNION ALL
  SELECT 'weighted avg', {sql_ratio('sum(prec * support)', 'sum(support)')}, {sql_ratio('sum(rec * support)', 'sum(support)')},
         {sql_ratio('sum(f1 * support)', 'sum(support)')}, CAST(sum(support) AS BIGINT) FROM lr
  UNION ALL
  SELECT 'samples avg',
         (SELECT avg({sql_ratio('inter', 'np')}) FROM rowstat), (SELECT avg({sql_ratio('inter', 'ny')}) FROM rowstat),
         (SELECT avg({sql_ratio('2 * inter', 'ny + np')}) FROM rowstat), CAST(sum(support) AS BIGINT) FROM lr)
SELECT row_label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM allrows""")
def q_multilabel_report(spark, sf_dir):
    return metrics.multilabel_report(prediction_table(spark, sf_dir))


BIN_COUNTS = V.with_views(V.BIN) + """, bc AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,
         count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM bin)
"""


@query("binary_metrics", BIN_COUNTS + f"""
SELECT CAST(n AS BIGINT) AS n, round({sql_ratio('tp + tn', 'n')}, 6) AS accuracy,
       round({sql_ratio('tp', 'tp + fp')}, 6) AS precision, round({sql_ratio('tp', 'tp + fn')}, 6) AS recall,
       round({sql_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM bc""")
def q_binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(views.binary_labels(spark, sf_dir))


@query("binary_report", BIN_COUNTS + f""", k AS (
  SELECT n, tp, fp, fn, tn,
    {sql_ratio('tn', 'tn + fn')} AS p0, {sql_ratio('tn', 'tn + fp')} AS r0, {sql_ratio('2 * tn', '2 * tn + fn + fp')} AS f0,
    {sql_ratio('tp', 'tp + fp')} AS p1, {sql_ratio('tp', 'tp + fn')} AS r1, {sql_ratio('2 * tp', '2 * tp + fp + fn')} AS f1_,
    tn + fp AS s0, tp + fn AS s1 FROM bc)
SELECT * FROM (
  SELECT '0' AS row_label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM k
  UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1_, 6), CAST(s1 AS BIGINT) FROM k
  UNION ALL SELECT 'accuracy', NULL, NULL, round({sql_ratio('tp + tn', 'n')}, 6), CAST(n AS BIGINT) FROM k
  UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1_) / 2, 6), CAST(n AS BIGINT) FROM k
  UNION ALL SELECT 'weighted avg', round({sql_ratio('p0 * s0 + p1 * s1', 'n')}, 6), round({sql_ratio('r0 * s0 + r1 * s1', 'n')}, 6),
                   round({sql_ratio('f0 * s0 + f1_ * s1', 'n')}, 6), CAST(n AS BIGINT) FROM k)""")
def q_binary_report(spark, sf_dir):
    return metrics.binary_report(views.binary_labels(spark, sf_dir))


def sql_bce(x: str, y: str) -> str:
    return f"(greatest({x}, 0.0) - {x} * {y} + ln(1 + exp(-abs({x}))))"


@query("bce_loss", ML_SQL + f"""
, el AS (SELECT {sql_bce('logits[i + 1]', 'CAST(y_true[i + 1] AS DOUBLE)')} AS l
         FROM ml, range(0, {len(vocab.LABELS)}) t(i))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM ml) AS n, round(avg(l), 6) AS bce_mean, round(sum(l), 6) AS bce_sum FROM el""")
def q_bce_loss(spark, sf_dir):
    return metrics.bce_loss(prediction_table(spark, sf_dir))


@query("focal_loss", ML_SQL + f"""
, el AS (SELECT {sql_bce('logits[i + 1]', 'CAST(y_true[i + 1] AS DOUBLE)')} AS b
         FROM ml, range(0, {len(vocab.LABELS)}) t(i))
, fl AS (SELECT {vocab.FOCAL_ALPHA} * pow(1.0 - exp(-b), {vocab.FOCAL_GAMMA}) * b AS l FROM el)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM ml) AS n, round(avg(l), 6) AS focal_mean, round(sum(l), 6) AS focal_sum FROM fl""")
def q_focal_loss(spark, sf_dir):
    return metrics.focal_loss(prediction_table(spark, sf_dir))


# ---- L: label algebra -----------------------------------------------------------

def lab_view(spark, sf_dir):
    return views.labeled_docs(spark, sf_dir)


@query("parse_labels", V.with_views(V.LAB) +
       f"SELECT item_id, array_to_string({V.parse_labels('error_label')}, '; ') AS labels, "
       f"CAST(len({V.parse_labels('error_label')}) AS INTEGER) AS n_labels FROM lab")
def q_parse_labels(spark, sf_dir):
    from ..functions import labels as lb
    arr = lb.parse_labels(F.col("error_label"))
    return lab_view(spark, sf_dir).select("item_id", F.array_join(arr, "; ").alias("labels"),
                                          F.size(arr).alias("n_labels"))


@query("parse_labels_raw", V.with_views(V.LAB) +
       f"SELECT item_id, array_to_string({V.parse_labels_raw('error_label')}, '|') AS tokens, "
       f"CAST(len({V.parse_labels_raw('error_label')}) AS INTEGER) AS n_tokens FROM lab")
def q_parse_labels_raw(spark, sf_dir):
    from ..functions import labels as lb
    arr = lb.parse_labels_raw(F.col("error_label"))
    return lab_view(spark, sf_dir).select("item_id", F.array_join(arr, "|").alias("tokens"),
                                          F.size(arr).alias("n_tokens"))


@query("binarize_labels", V.with_views(V.LAB) +
       f"SELECT item_id, array_to_string({V.binarize(V.parse_labels('error_label'))}, ',') AS indicators FROM lab")
def q_binarize_labels(spark, sf_dir):
    from ..functions import labels as lb
    ind = lb.binarize(lb.parse_labels(F.col("error_label")))
    return lab_view(spark, sf_dir).select(
        "item_id", F.array_join(F.transform(ind, lambda x: x.cast("string")), ",").alias("indicators"))


PRED_SQL = V.with_views(V.LOGIT) + f""", pr AS (
  SELECT item_id, logits, true_labels, {V.sigmoid_list('logits')} AS probs,
         list_transform({V.sigmoid_list('logits')}, lambda p: CAST(p > 0.5 AS INTEGER)) AS ind FROM logit)
"""


@query("decode_labels", PRED_SQL + f"SELECT item_id, {V.decode('ind')} AS pred_error FROM pr")
def q_decode_labels(spark, sf_dir):
    from ..functions import labels as lb
    lg = views.logits(spark, sf_dir)
    ind = lb.above(lb.sigmoid(F.col("logits")), lb.thresholds(None))
    return lg.select("item_id", lb.decode(ind).alias("pred_error"))


# per-label thresholds used to exercise the list form
LIST_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.5, 0.5, 0.5, 0.5, 0.5, 0.9]


@query("sigmoid_threshold", V.with_views(V.LOGIT) +
       f"SELECT item_id, array_to_string(list_transform(range(0, 11), lambda i: "
       f"CAST(1.0 / (1.0 + exp(-logits[i + 1])) > {LIST_THRESHOLDS}[i + 1] AS INTEGER)), ',') AS indicators FROM logit")
def q_sigmoid_threshold(spark, sf_dir):
    from ..functions import labels as lb
    lg = views.logits(spark, sf_dir)
    ind = lb.above(lb.sigmoid(F.col("logits")), lb.thresholds(LIST_THRESHOLDS))
    return lg.select("item_id", F.array_join(F.transform(ind, lambda x: x.cast("string")), ",")
                     .alias("indicators"))


@query("label_probs", PRED_SQL + "SELECT item_id, " + ", ".join(
    f"round(probs[{i + 1}], 6) AS {V.lit(lab + '_prob').replace(chr(39), chr(34))}"
    for i, lab in enumerate(vocab.LABELS)) + " FROM pr")
def q_label_probs(spark, sf_dir):
    from ..functions import labels as lb
    lg = views.logits(spark, sf_dir).withColumn("p", lb.sigmoid(F.col("logits")))
    return lg.select("item_id", *[F.round(F.col("p")[i], 6).alias(f"{lab}_prob")
                                  for i, lab in enumerate(vocab.LABELS)])


@query("softmax_argmax", V.with_views(V.LOGIT) + """, two AS (
  SELECT item_id, [logits[1], logits[2]] AS l FROM logit)
, sm AS (SELECT item_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM two)
, pr AS (SELECT item_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sm)
SELECT item_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS verify_label,
       round(p[2], 6) AS positive_prob FROM pr""")
def q_softmax_argmax(spark, sf_dir):
    from ..functions import labels as lb
    lg = views.logits(spark, sf_dir)
    p = lb.softmax(F.slice(F.col("logits"), 1, 2))
    return lg.select("item_id", p.alias("p")).select(
        "item_id", lb.argmax(F.col("p")).alias("verify_label"),
        F.round(F.col("p")[1], 6).alias("positive_prob"))


@query("labels_equal", V.with_views(GEN_SQL_VIEW) + f"""
, g2 AS (SELECT item_id, {sql_json_field('response', 'error_label')} AS gl,
                {V.label_string('item_id + 1')} AS other FROM gen)
, t AS (SELECT item_id, list_transform({V.parse_labels_raw('gl')}, lambda x: lower(x)) AS a,
               list_transform({V.parse_labels_raw('other')}, lambda x: lower(x)) AS b FROM g2)
SELECT item_id, CAST(list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AND len(a) = len(b) AS INTEGER) AS equal
FROM t WHERE a IS NOT NULL""")
def q_labels_equal(spark, sf_dir):
    from ..functions import labels as lb
    from ..functions import parse as P
    from ..sources.views import _label_string
    g = views.generated(spark, sf_dir)
    a = lb.parse_labels_raw(P.parse_generated_json(F.col("response"))["error_label"])
    b = lb.parse_labels_raw(_label_string(F.col("item_id") + 1))
    return g.select("item_id", a.alias("a"), b.alias("b")).filter(F.col("a").isNotNull()) \
        .select("item_id", lb.labels_equal(F.col("a"), F.col("b")).cast("int").alias("equal"))


# ---- A1-A3, O1-O2: label statistics -----------------------------------------------

DIST_SQL = V.with_views(V.LAB) + f""", tok AS (SELECT unnest({V.parse_labels_raw('error_label')}) AS label FROM lab)
, dist AS (SELECT label, CAST(count(*) AS BIGINT) AS count FROM tok GROUP BY label)
, distp AS (SELECT label, count, CAST(count AS DOUBLE) / (SELECT sum(count) FROM dist) AS proportion FROM dist)
"""


@query("label_distribution", DIST_SQL + "SELECT label, count, round(proportion, 6) AS proportion FROM distp")
def q_label_distribution(spark, sf_dir):
    from ..operators import distribution as D
    d = D.label_distribution(lab_view(spark, sf_dir))
    return d.select("label", "count", F.round("proportion", 6).alias("proportion"))


@query("sort_distribution", DIST_SQL +
       "SELECT label, count, CAST(row_number() OVER (ORDER BY count DESC, label) AS INTEGER) AS rank FROM distp")
def q_sort_distribution(spark, sf_dir):
    from pyspark.sql import Window
    from ..operators import distribution as D
    d = D.label_distribution(lab_view(spark, sf_dir))
    # the window runs over the aggregated table: one row per distinct label
    w = Window.orderBy(F.desc("count"), F.asc("label"))
    return D.sort_distribution(d).select("label", "count", F.row_number().over(w).alias("rank"))


def _factor_values() -> str:
    names = sorted(set(vocab.DEFAULT_DIFFICULTY) | set(vocab.DEFAULT_IMPORTANCE))
    rows = ", ".join(
        f"({V.lit(n)}, {vocab.DEFAULT_DIFFICULTY.get(n, 'NULL')}, {vocab.DEFAULT_IMPORTANCE.get(n, 'NULL')})"
        for n in names)
    return f"fac(label, difficulty, importance) AS (VALUES {rows})"


WEIGHTS_SQL = DIST_SQL + f""", {_factor_values()}
, w0 AS (
  SELECT d.label, d.proportion AS base_proportion, d.count,
         CAST(coalesce(f.difficulty, 1.0) AS DOUBLE) AS difficulty,
         CAST(coalesce(f.importance, 1.0) AS DOUBLE) AS importance,
         CASE WHEN d.count < (SELECT avg(count) FROM dist)
              THEN {vocab.DEFAULT_MIN_BOOST} + {round(vocab.DEFAULT_MAX_BOOST - vocab.DEFAULT_MIN_BOOST, 12)} * ({V.md5_u32(vocab.SPLIT_SEED, 'd.label')} / 4294967296.0)
              ELSE 1.0 END AS freq_boost
  FROM distp d LEFT JOIN fac f ON f.label = d.label)
, w1 AS (SELECT *, base_proportion * difficulty * importance * freq_boost AS final_weight_raw FROM w0)
, w2 AS (SELECT *, final_weight_raw / (SELECT sum(final_weight_raw) FROM w1) AS final_weight_norm FROM w1)
"""


def weights_df(spark, sf_dir, labeled=None):
    from ..operators import distribution as D
    src = labeled if labeled is not None else lab_view(spark, sf_dir)
    return D.label_weights(D.label_distribution(src, known_only=labeled is not None),
                           vocab.DEFAULT_DIFFICULTY, vocab.DEFAULT_IMPORTANCE)


@query("label_weights", WEIGHTS_SQL + """
SELECT label, round(base_proportion, 6) AS base_proportion, count, round(difficulty, 6) AS difficulty,
       round(importance, 6) AS importance, round(freq_boost, 6) AS freq_boost,
       round(final_weight_raw, 6) AS final_weight_raw, round(final_weight_norm, 6) AS final_weight_norm FROM w2""")
def q_label_weights(spark, sf_dir):
    w = weights_df(spark, sf_dir)
    return w.select("label", *[F.round(c, 6).alias(c) for c in
                               ("base_proportion",)], "count",
                    *[F.round(c, 6).alias(c) for c in ("difficulty", "importance", "freq_boost",
                                                       "final_weight_raw", "final_weight_norm")])


@query("sort_weights", WEIGHTS_SQL +
       "SELECT label, round(final_weight_norm, 6) AS final_weight_norm, "
       "CAST(row_number() OVER (ORDER BY final_weight_norm DESC, label) AS INTEGER) AS rank FROM w2")
def q_sort_weights(spark, sf_dir):
    from pyspark.sql import Window
    from ..operators import distribution as D
    w = D.sort_weights(weights_df(spark, sf_dir))
    win = Window.orderBy(F.desc("final_weight_norm"), F.asc("label"))
    return w.select("label", F.round("final_weight_norm", 6).alias("final_weight_norm"),
                    F.row_number().over(win).alias("rank"))


# ---- V1-V3, J6, P8, A2: voting --------------------------------------------------------

REVIEW_COLS = ["check-gemini", "check-gpt", "check-claude"]
LOWP = V.list_lit(vocab.LOW_PRECISION_LABELS)


def _sql_votes(thres: str) -> str:
    return " + ".join(f'(CASE WHEN "{c}" >= {thres} AND NOT isnan("{c}") THEN 1 ELSE 0 END)'
                      for c in REVIEW_COLS)


THRES_SQL = V.with_views(V.REV) + f""", rq AS (
  SELECT *, coalesce(list_has_any({V.parse_labels_raw('error_label')}, {LOWP}), false) AS low FROM rev)
"""


@query("required_thresholds", THRES_SQL + f"""
SELECT item_id,
       CAST(CASE WHEN low THEN {vocab.LOW_PRECISION_THRESHOLD} ELSE {vocab.DEFAULT_REVIEW_THRESHOLD} END AS DOUBLE) AS thres_by_threshold,
       CAST({vocab.DEFAULT_VOTES} AS INTEGER) AS votes_by_threshold,
       CAST({vocab.DEFAULT_REVIEW_THRESHOLD} AS DOUBLE) AS thres_by_vote,
       CAST(CASE WHEN low THEN {vocab.LOW_PRECISION_VOTES} ELSE {vocab.DEFAULT_VOTES} END AS INTEGER) AS votes_by_vote
FROM rq""")
def q_required_thresholds(spark, sf_dir):
    from ..operators import voting as VT
    r = views.review_scores(spark, sf_dir)
    a = VT.required_thresholds(r, by="threshold", low_precision=vocab.LOW_PRECISION_LABELS)
    b = VT.required_thresholds(a.withColumnRenamed("required_thres", "thres_by_threshold")
                               .withColumnRenamed("required_vote", "votes_by_threshold"),
                               by="vote", low_precision=vocab.LOW_PRECISION_LABELS)
    return b.select("item_id", "thres_by_threshold", "votes_by_threshold",
                    F.col("required_thres").alias("thres_by_vote"),
                    F.col("required_vote").alias("votes_by_vote"))


VOTE_SQL = THRES_SQL + f""", vt AS (
  SELECT *, CAST(CASE WHEN low THEN {vocab.LOW_PRECISION_THRESHOLD} ELSE {vocab.DEFAULT_REVIEW_THRESHOLD} END AS DOUBLE) AS required_thres,
         CAST({vocab.DEFAULT_VOTES} AS INTEGER) AS required_vote FROM rq)
, vv AS (SELECT *, CAST({_sql_votes('required_thres')} AS INTEGER) AS vote FROM vt)
"""


def _voted(spark, sf_dir, with_score):
    from ..operators import voting as VT
    r = views.review_scores(spark, sf_dir)
    return VT.vote_filter(r, REVIEW_COLS, "vote", vocab.DEFAULT_REVIEW_THRESHOLD,
                          vocab.LOW_PRECISION_LABELS, by="threshold", return_with_score=with_score)


@query("vote_filter", VOTE_SQL +
       "SELECT item_id, error_label, vote, required_vote, required_thres FROM vv WHERE vote >= required_vote")
def q_vote_filter(spark, sf_dir):
    return _voted(spark, sf_dir, True).select("item_id", "error_label", "vote", "required_vote",
                                              "required_thres")


@query("drop_helper_cols", VOTE_SQL +
       'SELECT item_id, error_label, "check-gemini", "check-gpt", "check-claude" FROM vv WHERE vote >= required_vote')
def q_drop_helper_cols(spark, sf_dir):
    return _voted(spark, sf_dir, False)


# bar for the mean strategy in the registered query (the reviewer replies in
# the derived table are spread evenly over [0, 1], so a bar below the vote
# threshold keeps a visible share of rows)
AVG_THRESHOLD = 0.65


@query("avg_filter", V.with_views(V.REV) + f"""
, av AS (SELECT item_id, list_filter(["check-gemini", "check-gpt", "check-claude"], lambda x: x IS NOT NULL AND NOT isnan(x)) AS v FROM rev)
SELECT item_id, round(list_sum(v) / len(v), 6) AS avg_score FROM av
WHERE len(v) > 0 AND list_sum(v) / len(v) >= {AVG_THRESHOLD}""")
def q_avg_filter(spark, sf_dir):
    from ..operators import voting as VT
    r = views.review_scores(spark, sf_dir)
    return VT.vote_filter(r, REVIEW_COLS, "avg", AVG_THRESHOLD,
                          return_with_score=True).select(
        "item_id", F.round("avg_score", 6).alias("avg_score"))


@query("accepted_label_counts", VOTE_SQL + f"""
, tok AS (SELECT unnest({V.parse_labels_raw('error_label')}) AS label FROM vv WHERE vote >= required_vote)
SELECT label, CAST(count(*) AS BIGINT) AS count FROM tok WHERE label <> '' GROUP BY label""")
def q_accepted_label_counts(spark, sf_dir):
    from ..operators import distribution as D
    return D.accepted_label_counts(_voted(spark, sf_dir, False))


@query("merge_reviews", V.with_views(V.LAB, REVL_SQL) + f"""
, conf AS (SELECT item_id, reviewer, TRY_CAST({V.ustrip('response')} AS DOUBLE) AS confidence FROM revl)
, wide AS (SELECT item_id,
    max(confidence) FILTER (WHERE reviewer = 'gemini') AS "check-gemini",
    max(confidence) FILTER (WHERE reviewer = 'gpt') AS "check-gpt",
    max(confidence) FILTER (WHERE reviewer = 'claude') AS "check-claude" FROM conf GROUP BY item_id)
SELECT lab.item_id, lab.error_label, wide."check-gemini", wide."check-gpt", wide."check-claude"
FROM lab LEFT JOIN wide ON wide.item_id = lab.item_id""")
def q_merge_reviews(spark, sf_dir):
    from ..functions import parse as P
    from ..operators import voting as VT
    conf = views.review_long(spark, sf_dir).select(
        "item_id", "reviewer", P.parse_confidence(F.col("response")).alias("confidence"))
    return VT.merge_reviews(lab_view(spark, sf_dir), conf)


# ---- J / R: prompts ---------------------------------------------------------------

def qa_view(spark, sf_dir):
    return views.qa_items(spark, sf_dir)


def qa_labeled_filled(spark, sf_dir):
    """V-QA rows with their document's label; rows without one get ``''``."""
    from ..operators import rows
    lab = lab_view(spark, sf_dir).select(F.col("item_id").alias("doc_id"), "error_label")
    return rows.fill_empty(qa_view(spark, sf_dir).join(lab, "doc_id", "left"))


def seed_view(spark, sf_dir):
    """V-SEED: the labelled rows, as seeds and training need them."""
    from ..operators import rows
    return rows.drop_unlabeled(views.labeled_qa(spark, sf_dir), ["error_label"])


def templates_df(spark):
    from ..operators import prompts
    return prompts.packaged_templates(spark)


def _tpl_sql() -> str:
    from ..operators import prompts
    return V.templates_values(prompts.template_rows())


QA_SLOTS_SQL = [("#passage", "passage"), ("#answer", "answer"), ("#question", "question")]


@query("all_dimensions", V.with_views(V.QA, V.QA_DIM) + "SELECT item_id, dimension FROM qad")
def q_all_dimensions(spark, sf_dir):
    from ..operators import prompts
    return prompts.all_dimensions(qa_view(spark, sf_dir).select("item_id"))


LABD_SQL = V.with_views(V.LAB) + f", labd AS (SELECT lab.*, unnest({V.DIMS}) AS dimension FROM lab)\n"


@query("relevant_errors", LABD_SQL +
       f"SELECT item_id, dimension, array_to_string({V.relevant('error_label', 'dimension')}, '; ') AS relevant FROM labd")
def q_relevant_errors(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(prompts.with_parsed_labels(lab_view(spark, sf_dir)))
    return x.select("item_id", "dimension", F.array_join(
        prompts.relevant_errors(F.col(prompts.PARSED), F.col("dimension")), "; ").alias("relevant"))


@query("describe_errors", LABD_SQL +
       f"SELECT item_id, dimension, {V.describe(V.relevant('error_label', 'dimension'))} AS evidence FROM labd")
def q_describe_errors(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(prompts.with_parsed_labels(lab_view(spark, sf_dir)))
    return x.select("item_id", "dimension", prompts.describe_errors(
        prompts.relevant_errors(F.col(prompts.PARSED), F.col("dimension"))).alias("evidence"))


def _direct_prompt_sql():
    return (V.with_views(V.QA, V.QA_DIM, _tpl_sql()) +
            f"SELECT q.item_id, q.dimension, {V.fill('t.body', QA_SLOTS_SQL)} AS prompt "
            "FROM qad q JOIN tpl t ON t.kind = 'direct' AND t.dimension = q.dimension")


@query("attach_template", V.with_views(V.QA, V.QA_DIM, _tpl_sql()) +
       "SELECT q.item_id, q.dimension, t.body AS template FROM qad q "
       "JOIN tpl t ON t.kind = 'direct' AND t.dimension = q.dimension")
def q_attach_template(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(qa_view(spark, sf_dir).select("item_id"))
    return prompts.attach_template(x, templates_df(spark), "direct").select(
        "item_id", "dimension", "template")


@query("render_prompt", _direct_prompt_sql())
def q_render_prompt(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(qa_view(spark, sf_dir))
    return prompts.render_prompt(x, templates_df(spark)).select("item_id", "dimension", "prompt")


@query("load_templates", _direct_prompt_sql())
def q_load_templates(spark, sf_dir):
    """Direct prompts with templates read by ``spark.read.text(wholetext)`` from
    a folder that all executors share."""
    from ..operators import prompts
    from ..sources import tables
    root = _scratch(spark, "templates")
    tables.save_templates(spark, prompts.template_rows(), root)
    tpl = tables.load_templates(spark, root)
    x = prompts.all_dimensions(qa_view(spark, sf_dir))
    return prompts.render_prompt(x, tpl).select("item_id", "dimension", "prompt")


def _error_fill(label="error_label"):
    ev = V.describe(V.relevant(label, "q.dimension"))
    return V.fill("t.body", QA_SLOTS_SQL + [("#error", ev)])


ERR_BASE = V.with_views(V.QA, V.LAB, V.QA_LAB, _tpl_sql()) + \
    f", qald AS (SELECT qal.*, unnest({V.DIMS}) AS dimension FROM qal)\n"


@query("render_error_prompt", ERR_BASE +
       f"SELECT q.item_id, q.dimension, {_error_fill()} AS prompt FROM qald q "
       "JOIN tpl t ON t.kind = 'error' AND t.dimension = q.dimension")
def q_render_error_prompt(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(prompts.with_parsed_labels(qa_labeled_filled(spark, sf_dir)))
    return prompts.render_error_prompt(x, templates_df(spark)).select("item_id", "dimension", "prompt")


@query("render_api_prompt", ERR_BASE +
       f"SELECT q.item_id, q.dimension, {V.lit(vocab.SYSTEM_EVALUATOR)} AS system, "
       f"CASE WHEN error_label = '' THEN {V.fill('t.body', QA_SLOTS_SQL)} ELSE {_error_fill()} END AS user "
       "FROM qald q JOIN tpl t ON t.kind = 'error' AND t.dimension = q.dimension")
def q_render_api_prompt(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(prompts.with_parsed_labels(qa_labeled_filled(spark, sf_dir)))
    x = prompts.with_messages(prompts.render_error_prompt(x, templates_df(spark), keep_empty_slot=True))
    return x.select("item_id", "dimension", F.col("messages")[0]["content"].alias("system"),
                    F.col("messages")[1]["content"].alias("user"))


@query("render_batch", ERR_BASE +
       f"SELECT q.item_id, q.dimension, {V.lit(vocab.SYSTEM_EVALUATOR)} AS system, {_error_fill()} AS user "
       "FROM qald q JOIN tpl t ON t.kind = 'error' AND t.dimension = q.dimension")
def q_render_batch(spark, sf_dir):
    from ..operators import prompts
    lab = lab_view(spark, sf_dir).select(F.col("item_id").alias("doc_id"), "error_label")
    qa = qa_view(spark, sf_dir).join(lab, "doc_id", "left")
    x = prompts.render_batch(qa, templates_df(spark), error_aware=True)
    return x.select("item_id", "dimension", F.col("messages")[0]["content"].alias("system"),
                    F.col("messages")[1]["content"].alias("user"))


@query("build_messages", "WITH dp AS (" + _direct_prompt_sql().replace("WITH ", "WITH ", 1) + ")\n" +
       f"SELECT item_id, dimension, 0 AS pos, 'system' AS role, {V.lit(vocab.SYSTEM_EVALUATOR)} AS content FROM dp "
       "UNION ALL SELECT item_id, dimension, 1, 'user', prompt FROM dp")
def q_build_messages(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(qa_view(spark, sf_dir))
    x = prompts.with_messages(prompts.render_prompt(x, templates_df(spark)))
    return x.select("item_id", "dimension", F.posexplode("messages").alias("pos", "m")).select(
        "item_id", "dimension", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


CHAT_SQL = ("SELECT conv_id, " + V.lit(vocab.CHAT_BEGIN) + " || string_agg(" + V.lit(vocab.CHAT_HEADER_START) +
            " || role || " + V.lit(vocab.CHAT_HEADER_END) + " || " + V.ustrip("text") + " || " +
            V.lit(vocab.CHAT_TURN_END) + ", '' ORDER BY turn) || " +
            V.lit(vocab.CHAT_HEADER_START + "assistant" + vocab.CHAT_HEADER_END) +
            " AS chat FROM conversations GROUP BY conv_id")


@query("render_chat", CHAT_SQL)
def q_render_chat(spark, sf_dir):
    from ..operators import prompts
    return prompts.chat_transcripts(views.chats(spark, sf_dir))


SEED_SQL = V.with_views(V.QA, V.LAB, V.SEED)

FEW_SHOT_SQL_EXPR = ("'---' || chr(10) || '        Passage: ' || {p}passage || chr(10) || '        Answer: ' || {p}answer"
                     " || chr(10) || '        Question: ' || {p}question || chr(10) || '        Error_label: ' || {p}error_label"
                     " || chr(10) || '    ---'")


@query("few_shot_block", SEED_SQL + "SELECT item_id, " + FEW_SHOT_SQL_EXPR.format(p="") + " AS block FROM seed")
def q_few_shot_block(spark, sf_dir):
    from ..functions import text as tx
    s = seed_view(spark, sf_dir)
    return s.select("item_id", tx.few_shot_block(F.col("passage"), F.col("answer"), F.col("question"),
                                                 F.col("error_label")).alias("block"))


@query("render_review_prompt", V.with_views(V.QA, V.LAB, V.SEED, _tpl_sql()) +
       "SELECT item_id, " + V.fill("(SELECT body FROM tpl WHERE kind = 'review')",
                                   [("{{PASSAGE}}", "passage"), ("{{ANSWER}}", "answer"),
                                    ("{{QUESTION}}", "question"), ("{{ERROR}}", "error_label")]) +
       " AS prompt FROM seed")
def q_render_review_prompt(spark, sf_dir):
    from ..operators import prompts
    return prompts.render_review_prompt(seed_view(spark, sf_dir), templates_df(spark)) \
        .select("item_id", "prompt")


@query("render_identify_prompt", V.with_views(V.QA, _tpl_sql()) +
       "SELECT item_id, " + V.fill("(SELECT body FROM tpl WHERE kind = 'identify')", QA_SLOTS_SQL) +
       " AS prompt FROM qa")
def q_render_identify_prompt(spark, sf_dir):
    from ..operators import prompts
    return prompts.render_identify_prompt(qa_view(spark, sf_dir), templates_df(spark)) \
        .select("item_id", "prompt")


SEP = vocab.sep_token("roberta")


@query("identifier_text", V.with_views(V.QA) +
       f"SELECT item_id, question || {V.lit(SEP)} || answer || {V.lit(SEP)} || passage AS text FROM qa")
def q_identifier_text(spark, sf_dir):
    from ..operators import prompts
    q = qa_view(spark, sf_dir)
    return q.select("item_id", prompts.identifier_text(F.col("question"), F.col("answer"),
                                                       F.col("passage")).alias("text"))


@query("verifier_text", SEED_SQL +
       f"SELECT item_id, error_label || {V.lit(SEP)} || question || {V.lit(SEP)} || answer || "
       f"{V.lit(SEP)} || passage AS text FROM seed")
def q_verifier_text(spark, sf_dir):
    from ..operators import prompts
    s = seed_view(spark, sf_dir)
    return s.select("item_id", prompts.verifier_text(F.col("error_label"), F.col("question"),
                                                     F.col("answer"), F.col("passage")).alias("text"))


@query("truncate_tokens", V.with_views(V.QA) + f"""
, tk AS (SELECT item_id, regexp_split_to_array({V.ustrip(f"question || {V.lit(SEP)} || answer || {V.lit(SEP)} || passage")}, '\\s+') AS toks FROM qa)
SELECT item_id, array_to_string(toks[1:{vocab.MAX_TOKENS}], ' ') AS text,
       CAST(len(toks[1:{vocab.MAX_TOKENS}]) AS INTEGER) AS n_tokens FROM tk""")
def q_truncate_tokens(spark, sf_dir):
    from ..functions import text as tx
    from ..operators import prompts
    q = qa_view(spark, sf_dir)
    t = tx.truncate_tokens(prompts.identifier_text(F.col("question"), F.col("answer"), F.col("passage")))
    return q.select("item_id", t.alias("text")).withColumn(
        "n_tokens", F.size(F.split(F.col("text"), " ")))


# ---- P / J: rows and key joins -------------------------------------------------------

@query("drop_unlabeled", V.with_views(V.LAB) +
       "SELECT item_id, error_label FROM lab WHERE error_label IS NOT NULL")
def q_drop_unlabeled(spark, sf_dir):
    from ..operators import rows
    return rows.drop_unlabeled(lab_view(spark, sf_dir))


@query("fill_empty", V.with_views(V.LAB) +
       "SELECT item_id, coalesce(error_label, '') AS error_label FROM lab")
def q_fill_empty(spark, sf_dir):
    from ..operators import rows
    return rows.fill_empty(lab_view(spark, sf_dir))


@query("cast_label", V.with_views(V.LAB) +
       "SELECT lab.item_id, lab.error_label AS pred_error, CAST(l.quality AS INTEGER) AS label "
       "FROM lab JOIN labels l ON l.doc_id = lab.item_id")
def q_cast_label(spark, sf_dir):
    from ..operators import rows
    lb = views.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), F.col("quality").alias("label"))
    x = lab_view(spark, sf_dir).withColumnRenamed("error_label", "pred_error").join(lb, "item_id")
    return rows.cast_label(x, "label", ["pred_error"])


@query("exclude_clean", V.with_views(V.LAB) +
       "SELECT item_id, error_label FROM lab WHERE error_label IS DISTINCT FROM 'No Error'")
def q_exclude_clean(spark, sf_dir):
    from ..operators import rows
    return rows.exclude_clean(lab_view(spark, sf_dir))


@query("model_family",
       "SELECT doc_id AS item_id, split_part(source, '_', 1) || '_GPT-4' AS source_tag, "
       "split_part(lang || '-' || source, '-', 1) AS family FROM documents")
def q_model_family(spark, sf_dir):
    from ..operators import rows
    d = views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.select(F.col("doc_id").alias("item_id"),
                    rows.generated_source(F.col("source")).alias("source_tag"),
                    rows.model_family(F.concat_ws("-", "lang", "source")).alias("family"))


MODELS = ["m0", "m1", "m2"]


def _wide_sql():
    cols = []
    for d in vocab.DIMENSIONS:
        for m in MODELS[:2]:
            cond = f"dimension = {V.lit(d)} AND model = {V.lit(m)}"
            cols.append(f'max(CASE WHEN {cond} THEN response END) AS "{d}_{m}"')
            cols.append(f'arg_max(score, response) FILTER ({cond} AND response IS NOT NULL) AS "{d}_{m}_score"')
            cols.append(f"max(CASE WHEN {cond} THEN coalesce(regexp_extract(response, '(?s)^(.*)</think>', 1), '') END)"
                        f' AS "{d}_{m}_thinking"')
    names = V.list_lit([f"{d}_{m}" for d in vocab.DIMENSIONS for m in MODELS[:2]])
    return V.with_views(V.RESP, V.SCORED) + "SELECT item_id, CAST(count(*) FILTER (NOT list_contains(" + names + \
        ", dimension || '_' || model)) AS INTEGER) AS n_unlisted, " + ", ".join(cols) + " FROM scored GROUP BY item_id"


@query("wide_scores", _wide_sql())
def q_wide_scores(spark, sf_dir):
    from ..operators import rows
    return rows.wide_scores(scored_responses(spark, sf_dir), vocab.DIMENSIONS, MODELS[:2])


@query("pair_rating_pred", V.with_views(V.RESP, V.SCORED) +
       "SELECT r.item_id, r.dimension, r.rating, s.model, s.score FROM resp r "
       "JOIN scored s ON s.item_id = r.item_id AND s.dimension = r.dimension")
def q_pair_rating_pred(spark, sf_dir):
    from ..operators import rows
    s = scored_responses(spark, sf_dir)
    ratings = s.select("item_id", "dimension", "rating")
    preds = s.select("item_id", "dimension", "model", "score")
    return rows.pair_rating_pred(ratings, preds)


@query("unmatched_ratings", V.with_views(V.RESP) +
       "SELECT dimension, CAST(count(*) AS BIGINT) AS n_rated, "
       "CAST(count(*) FILTER (item_id % 97 = 3) AS BIGINT) AS n_unmatched FROM resp GROUP BY dimension")
def q_unmatched_ratings(spark, sf_dir):
    """Ratings whose item has no prediction (every 97th reply is missing)."""
    from ..operators import rows
    r = views.responses(spark, sf_dir)
    return rows.count_unmatched(r.select("item_id", "dimension"), r.filter("item_id % 97 <> 3"))


@query("meta_evaluate", V.with_views(V.RESP, V.SCORED) + """
, lost AS (SELECT dimension, CAST(count(*) AS BIGINT) AS n_unmatched FROM resp WHERE item_id % 97 = 3 GROUP BY dimension)
SELECT s.dimension, model, CAST(count(*) AS BIGINT) AS n,
       round(CASE WHEN stddev_pop(rating) * stddev_pop(score) = 0 THEN NULL
                  ELSE covar_pop(rating, score) / (stddev_pop(rating) * stddev_pop(score)) END, 6) AS pearson_r,
       max(coalesce(n_unmatched, 0)) AS n_unmatched
FROM scored s LEFT JOIN lost ON lost.dimension = s.dimension
WHERE score <> 999 GROUP BY s.dimension, model""")
def q_meta_evaluate(spark, sf_dir):
    """All replies against their ratings, and ratings of items that nobody
    answered (negative ids, one for every 97th item)."""
    from . import jobs
    r = views.responses(spark, sf_dir)
    ratings = r.select("item_id", "dimension", "rating")
    extra = ratings.filter("item_id % 97 = 3").withColumn("item_id", -F.col("item_id"))
    return jobs.meta_evaluate(r.select("item_id", "dimension", "model", "response"), ratings.unionByName(extra))


REQ_SQL = V.with_views(V.QA, V.QA_DIM, V.RESP) + \
    f", req AS (SELECT item_id, dimension, unnest({V.list_lit(MODELS)}) AS model FROM qad)\n"


def requests_df(spark, sf_dir):
    from ..operators import prompts
    x = prompts.all_dimensions(qa_view(spark, sf_dir).select("item_id"))
    return x.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))


@query("pending_rows", REQ_SQL +
       "SELECT item_id, dimension, model FROM req WHERE NOT EXISTS (SELECT 1 FROM resp r WHERE "
       "r.item_id = req.item_id AND r.dimension = req.dimension AND r.model = req.model AND r.response <> '')")
def q_pending_rows(spark, sf_dir):
    from ..operators import rows
    done = views.responses(spark, sf_dir).filter(F.col("response") != "")
    return rows.pending_rows(requests_df(spark, sf_dir), done)


@query("join_recorded_responses", REQ_SQL +
       f"SELECT req.item_id, req.dimension, req.model, "
       f"CASE WHEN r.item_id IS NOT NULL THEN {V.extract_score('r.response')} END AS score "
       "FROM req LEFT JOIN resp r ON r.item_id = req.item_id AND r.dimension = req.dimension AND r.model = req.model")
def q_join_recorded_responses(spark, sf_dir):
    from ..operators import rows
    rec = rows.with_score(views.responses(spark, sf_dir)).select("item_id", "dimension", "model", "score")
    return rows.join_recorded_responses(requests_df(spark, sf_dir), rec)


@query("attach_predictions", PRED_SQL +
       "SELECT item_id, array_to_string(true_labels, '; ') AS true_labels, " + V.decode("ind") +
       " AS pred_error FROM pr")
def q_attach_predictions(spark, sf_dir):
    from ..functions import labels as lb
    from ..operators import rows
    lg = views.logits(spark, sf_dir)
    truth = lg.select("item_id", F.array_join("true_labels", "; ").alias("true_labels"))
    preds = lg.select("item_id", lb.decode(lb.above(lb.sigmoid(F.col("logits")),
                                                    lb.thresholds(None))).alias("pred_error"))
    return rows.attach_predictions(truth, preds)


# ---- V / J8 / R8: sampling ------------------------------------------------------------

def dist_sql(src: str) -> str:
    return f""", every AS (SELECT unnest({V.parse_labels_raw('error_label')}) AS label FROM {src})
, tok AS (SELECT label FROM every WHERE list_contains({V.VOCAB}, label))
, dist AS (SELECT label, CAST(count(*) AS BIGINT) AS count FROM tok GROUP BY label)
, distp AS (SELECT label, count, CAST(count AS DOUBLE) / (SELECT sum(count) FROM dist) AS proportion FROM dist)
"""


SEED_WEIGHTS_SQL = (V.with_views(V.QA, V.LAB, V.SEED) + dist_sql("seed") +
                    WEIGHTS_SQL[WEIGHTS_SQL.index(", fac(label"):])

DRAW_SQL = SEED_WEIGHTS_SQL + f""", cum AS (
  SELECT label, sum(final_weight_norm) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
         lead(label) OVER (ORDER BY label) AS nxt FROM w2)
, iv AS (SELECT label, coalesce(lag(c) OVER (ORDER BY label), 0.0) AS lo,
                CASE WHEN nxt IS NULL THEN 1.0 ELSE c END AS hi FROM cum)
, cu AS (SELECT item_id, passage, answer, {V.md5_u32(vocab.SPLIT_SEED, 'item_id')} / 4294967296.0 AS u FROM qa)
, drawn AS (SELECT cu.item_id, cu.passage, cu.answer, iv.label AS sampled_label
            FROM cu JOIN iv ON cu.u >= iv.lo AND cu.u < iv.hi AND iv.hi > iv.lo)
, stok AS (SELECT DISTINCT item_id, unnest({V.parse_labels_raw('error_label')}) AS label FROM seed)
, slots AS (SELECT label, item_id AS ex_item_id,
                   row_number() OVER (PARTITION BY label ORDER BY {V.md5_u32(vocab.SPLIT_SEED, 'item_id')}, item_id) - 1 AS slot,
                   count(*) OVER (PARTITION BY label) AS n FROM stok)
, shot AS (SELECT d.*, s.ex_item_id FROM drawn d JOIN slots s ON s.label = d.sampled_label
           AND s.slot = {V.md5_u32(vocab.SPLIT_SEED, "'shot'", 'd.item_id')} % s.n)
"""


def label_tokens_of(spark, sf_dir):
    """Just the label column of the seeds: all that the weights need."""
    return seed_view(spark, sf_dir).select("error_label")


def seed_table(spark, sf_dir):
    """Seed examples, written once as a parquet table in the shared
    checkpoint folder: the weights, the per-label slots and the example join
    all read it (pruned to the columns each needs)."""
    from ..session import materialize
    return materialize(seed_view(spark, sf_dir).select(
        "item_id", "passage", "answer", "question", "error_label"), "seeds")


def drawn_df(spark, sf_dir, seeds=None):
    from ..operators import sampling as S
    w = weights_df(spark, sf_dir, labeled=label_tokens_of(spark, sf_dir) if seeds is None else seeds)
    return S.weighted_label_sample(qa_view(spark, sf_dir), w)


def shots_df(spark, sf_dir):
    from ..operators import sampling as S
    seeds = seed_table(spark, sf_dir)
    return S.attach_few_shot(drawn_df(spark, sf_dir, seeds), seeds)


@query("weighted_label_sample", DRAW_SQL + "SELECT item_id, sampled_label FROM drawn")
def q_weighted_label_sample(spark, sf_dir):
    return drawn_df(spark, sf_dir).select("item_id", "sampled_label")


@query("attach_few_shot", DRAW_SQL + "SELECT item_id, sampled_label, ex_item_id FROM shot")
def q_attach_few_shot(spark, sf_dir):
    return shots_df(spark, sf_dir).select("item_id", "sampled_label", "ex_item_id")


@query("render_generation_prompt", DRAW_SQL + ", " + _tpl_sql() + f"""
, sx AS (SELECT sh.item_id, sh.passage, sh.answer, e.passage AS ex_passage, e.answer AS ex_answer,
                e.question AS ex_question, e.error_label AS ex_error_label
         FROM shot sh JOIN seed e ON e.item_id = sh.ex_item_id)
SELECT item_id, {V.fill("(SELECT body FROM tpl WHERE kind = 'generate')",
                        [("{{FEW_SHOT_EXAMPLES}}", FEW_SHOT_SQL_EXPR.format(p="ex_")),
                         ("{{ERROR}}", V.describe(V.parse_labels("ex_error_label"))),
                         ("{{PASSAGE}}", "passage"), ("{{ANSWER}}", "answer")])} AS prompt,
       array_to_string({V.parse_labels_raw("ex_error_label")}, '; ') AS target_labels FROM sx""")
def q_render_generation_prompt(spark, sf_dir):
    from ..operators import prompts
    x = prompts.render_generation_prompt(shots_df(spark, sf_dir), templates_df(spark))
    return x.select("item_id", "prompt", F.array_join("target_labels", "; ").alias("target_labels"))


@query("uniform_sample_one", V.with_views(V.QA) +
       f"SELECT item_id FROM qa ORDER BY {V.md5_u32(vocab.SPLIT_SEED, 'item_id')}, item_id LIMIT 1")
def q_uniform_sample_one(spark, sf_dir):
    from ..operators import sampling as S
    return S.uniform_sample_one(qa_view(spark, sf_dir)).select("item_id")


@query("train_dev_split", V.with_views(V.LAB) +
       f"SELECT item_id, CASE WHEN {V.md5_u32(vocab.SPLIT_SEED, 'item_id')} % 100 < {vocab.IDENTIFIER_DEV_SHARE} "
       "THEN 'dev' ELSE 'train' END AS split FROM lab")
def q_train_dev_split(spark, sf_dir):
    from ..operators import sampling as S
    return S.train_dev_split(lab_view(spark, sf_dir)).select("item_id", "split")


SLICE = 20


@query("candidate_slice", V.with_views(V.QA) +
       f"SELECT item_id, question FROM qa ORDER BY item_id LIMIT {SLICE}")
def q_candidate_slice(spark, sf_dir):
    from ..operators import sampling as S
    return S.candidate_slice(qa_view(spark, sf_dir).select("item_id", "question"), SLICE)


@query("rows_with_label", V.with_views(V.LAB) +
       f"SELECT DISTINCT unnest({V.parse_labels('error_label')}) AS label, item_id FROM lab")
def q_rows_with_label(spark, sf_dir):
    from ..operators import sampling as S
    return S.rows_with_label(lab_view(spark, sf_dir)).select("label", "item_id")


@query("row_counts", V.with_views(V.LAB) + f"""
SELECT CAST(count(*) AS BIGINT) AS n_input, CAST(count(error_label) AS BIGINT) AS n_labeled,
  CAST(count(*) FILTER (WHERE error_label IS NOT NULL AND {V.md5_u32(vocab.SPLIT_SEED, 'item_id')} % 100 >= {vocab.IDENTIFIER_DEV_SHARE}) AS BIGINT) AS n_train,
  CAST(count(*) FILTER (WHERE error_label IS NOT NULL AND {V.md5_u32(vocab.SPLIT_SEED, 'item_id')} % 100 < {vocab.IDENTIFIER_DEV_SHARE}) AS BIGINT) AS n_dev
FROM lab""")
def q_row_counts(spark, sf_dir):
    from ..operators import sampling as S
    x = S.train_dev_split(lab_view(spark, sf_dir))
    lab = F.col("error_label").isNotNull()
    return x.agg(F.count(F.lit(1)).alias("n_input"), F.count("error_label").alias("n_labeled"),
                 F.count_if(lab & (F.col("split") == "train")).alias("n_train"),
                 F.count_if(lab & (F.col("split") == "dev")).alias("n_dev"))


# ---- S: sources, sinks, incremental scoring ----------------------------------------------

@query("scan_table", "SELECT doc_id, source, CAST(length(text) AS INTEGER) AS n_chars FROM documents")
def q_scan_table(spark, sf_dir):
    from pyspark.sql import types as T
    from ..sources import tables
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("source", T.StringType())])
    d = tables.scan_table(spark, tables.table_path(sf_dir, "documents"), schema)
    return d.select("doc_id", "source", F.length("text").alias("n_chars"))


@query("read_table", "SELECT doc_id, lang FROM documents")
def q_read_table(spark, sf_dir):
    from ..sources import tables
    return tables.read_table(spark, tables.table_path(sf_dir, "documents")).select("doc_id", "lang")


def _scratch(spark, name):
    from ..session import scratch_path
    return scratch_path(spark, name)


@query("scan_json", V.with_views(V.QA) + "SELECT item_id, question, answer, source FROM qa")
def q_scan_json(spark, sf_dir):
    """Round trip: QA rows written as JSON lines, read back with a schema."""
    from ..sources import tables
    path = _scratch(spark, "qa-json")
    qa = qa_view(spark, sf_dir).select("item_id", "question", "answer", "source")
    tables.sink_json(qa, path)
    sch = tables.QA_SCHEMA
    return tables.scan_json(spark, path, sch).select("item_id", "question", "answer", "source")


@query("sink_json", V.with_views(V.QA) + "SELECT item_id, passage, question, answer FROM qa")
def q_sink_json(spark, sf_dir):
    from ..sources import tables
    path = _scratch(spark, "qa-json-full")
    tables.sink_json(qa_view(spark, sf_dir).select("item_id", "passage", "question", "answer"), path)
    return tables.read_table(spark, path, tables.QA_SCHEMA, fmt="json").select(
        "item_id", "passage", "question", "answer")


@query("sink_table", V.with_views(V.RESP, V.SCORED) + "SELECT item_id, dimension, model, score FROM scored")
def q_sink_table(spark, sf_dir):
    """Scored responses written partitioned by dimension, then read back."""
    from ..sources import tables
    path = _scratch(spark, "scored")
    tables.sink_table(scored_responses(spark, sf_dir).select("item_id", "dimension", "model", "score"),
                      path, partition_by=["dimension"])
    return spark.read.parquet(path).select("item_id", "dimension", "model", "score")


@query("sink_text", "SELECT chat AS value FROM (" + CHAT_SQL + ")")
def q_sink_text(spark, sf_dir):
    """Rendered transcripts written as text records (record separator 0x1E,
    since transcripts hold newlines) and read back."""
    from ..operators import prompts
    path = _scratch(spark, "chats-text")
    from ..sources import tables
    tables.sink_text(prompts.chat_transcripts(views.chats(spark, sf_dir)), "chat", path)
    return tables.read_text(spark, path)


@query("incremental_score", V.with_views(V.RESP, V.SCORED) + "SELECT item_id, dimension, model, score FROM scored")
def q_incremental_score(spark, sf_dir):
    """Each evaluator model's responses arrive as their own file drop; one
    availableNow run per drop over the same checkpoint scores each drop
    exactly once. The union of the runs equals the batch result."""
    from ..streaming import incremental as inc
    base = _scratch(spark, "incremental")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    r = views.responses(spark, sf_dir).select("item_id", "dimension", "model", "response")
    drops = [F.col("model") == m for m in MODELS] + [~F.col("model").isin(MODELS)]
    for cond in drops:  # every row lands in exactly one drop
        r.filter(cond).write.mode("append").parquet(src)
        inc.run_incremental(spark, src, sink, ckpt)
    return inc.read_scored(spark, sink).select("item_id", "dimension", "model", "score")


# ---- X4 / X6: validation of generated rows -----------------------------------------------

ATTEMPTS_SQL = V.with_views(V.QA, V.LAB, V.SEED) + f""", att AS (
  SELECT s.*, k AS attempt,
         'Generated question ' || CAST(k AS VARCHAR) || ' about ' || s.source || '?' AS gq,
         CASE WHEN (s.item_id + k) % 3 = 0 THEN 'Spell Error' ELSE s.error_label END AS gl
  FROM seed s, range(1, {vocab.GENERATION_ATTEMPTS + 1}) t(k))
, att2 AS (
  SELECT *, CASE (item_id + attempt) % 4
      WHEN 0 THEN '{{"question": "' || gq || '", "error_label": "' || gl || '"}}'
      WHEN 1 THEN '```json' || chr(10) || '{{"question": "' || gq || '", "error_label": "' || gl || '"}}' || chr(10) || '```'
      WHEN 2 THEN '{{''question'': ''' || gq || ''', ''error_label'': ''' || gl || '''}}'
      ELSE 'not json ' || CAST(attempt AS VARCHAR) END AS response
  FROM att)
, parsed AS (
  SELECT *, {sql_json_field('response', 'question')} AS gen_question,
            {sql_json_field('response', 'error_label')} AS gen_label FROM att2)
, ok AS (
  SELECT * FROM parsed
  WHERE coalesce(gen_question, '') <> '' AND coalesce(gen_label, '') <> ''
    AND list_sort(list_distinct(list_transform({V.parse_labels_raw('error_label')}, lambda x: lower(x))))
        = list_sort(list_distinct(list_transform({V.parse_labels_raw('gen_label')}, lambda x: lower(x))))
    AND len({V.parse_labels_raw('error_label')}) = len({V.parse_labels_raw('gen_label')}))
, best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt) = 1)
"""


def attempts_df(spark, sf_dir):
    """Three generator replies per seed row in rotating styles; some carry a
    wrong label so that validation rejects them."""
    from ..functions import labels as lb
    s = seed_view(spark, sf_dir)
    x = s.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(vocab.GENERATION_ATTEMPTS))))
    k = F.col("item_id") + F.col("attempt")
    gq = F.concat(F.lit("Generated question "), F.col("attempt").cast("string"), F.lit(" about "),
                  F.col("source"), F.lit("?"))
    gl = F.when(k % 3 == 0, F.lit("Spell Error")).otherwise(F.col("error_label"))
    dq = F.concat(F.lit('{"question": "'), gq, F.lit('", "error_label": "'), gl, F.lit('"}'))
    sq = F.concat(F.lit("{'question': '"), gq, F.lit("', 'error_label': '"), gl, F.lit("'}"))
    style = k % 4
    resp = (F.when(style == 0, dq).when(style == 1, F.concat(F.lit("```json\n"), dq, F.lit("\n```")))
            .when(style == 2, sq).otherwise(F.concat(F.lit("not json "), F.col("attempt").cast("string"))))
    return x.withColumn("response", resp).withColumn(
        "target_labels", lb.parse_labels_raw(F.col("error_label")))


@query("validate_generated", ATTEMPTS_SQL +
       "SELECT item_id, CAST(attempt AS INTEGER) AS attempt, gen_question AS question, gen_label AS error_label FROM best")
def q_validate_generated(spark, sf_dir):
    from ..operators import generation as G
    b = G.first_accepted(attempts_df(spark, sf_dir))
    return b.select("item_id", "attempt", F.col("gen_question").alias("question"),
                    F.col("gen_label").alias("error_label"))


@query("make_training_row", ATTEMPTS_SQL +
       "SELECT item_id, passage, answer, gen_question AS question, "
       "split_part(source, '_', 1) || '_GPT-4' AS source, gen_label AS error_label FROM best")
def q_make_training_row(spark, sf_dir):
    from ..operators import generation as G
    return G.make_training_row(G.first_accepted(attempts_df(spark, sf_dir)))


# ---- M7 / C: model calls and composite jobs ---------------------------------------------

RULE_REPLY = "'score: ' || CAST(1 + length(prompt) % 3 AS VARCHAR) || chr(10) || 'reason: rule of thumb'"


@query("complete_batch", "WITH dp AS (" + _direct_prompt_sql() + ")\n" +
       f"SELECT item_id, dimension, {RULE_REPLY} AS response FROM dp")
def q_complete_batch(spark, sf_dir):
    from ..operators import completion, prompts
    x = prompts.all_dimensions(qa_view(spark, sf_dir))
    x = prompts.with_messages(prompts.render_prompt(x, templates_df(spark)))
    return completion.complete_batch(x.select("item_id", "dimension", "messages"),
                                     standins.length_rule_evaluator)


@query("complete_routed", "WITH dp AS (" + _direct_prompt_sql() + f"""), m AS (
  SELECT *, ['rule-a', 'rule-fail', 'other'][item_id % 3 + 1] AS model FROM dp)
SELECT item_id, dimension, model, CASE model WHEN 'rule-a' THEN {RULE_REPLY}
       WHEN 'rule-fail' THEN CASE WHEN length(prompt) % 5 = 0 THEN '' ELSE {RULE_REPLY} END ELSE '' END AS response,
       CASE model WHEN 'other' THEN 'no model for this row' END AS failure FROM m""")
def q_complete_routed(spark, sf_dir):
    """Each row to the function of its model; an unknown model is reported."""
    from ..operators import completion, prompts
    x = prompts.with_messages(prompts.render_prompt(prompts.all_dimensions(qa_view(spark, sf_dir)),
                                                    templates_df(spark)))
    model = F.element_at(F.array(*map(F.lit, ("rule-a", "rule-fail", "other"))),
                         (F.col("item_id") % 3 + 1).cast("int"))
    return completion.complete_routed(
        x.select("item_id", "dimension", model.alias("model"), "messages"),
        {"fail": standins.failing_evaluator, "rule": standins.length_rule_evaluator}, failure_col="failure")


@query("evaluate_thinking", "WITH dp AS (" + _direct_prompt_sql() + """)
SELECT item_id, dimension, 'thinker' AS model, CAST(1 + length(prompt) % 3 AS INTEGER) AS score,
       'maybe score: 9' AS thinking FROM dp""")
def q_evaluate_thinking(spark, sf_dir):
    """A model that names another score while reasoning: only the text behind
    the marker is scored, the reasoning is kept."""
    from . import jobs
    out = jobs.evaluate(qa_view(spark, sf_dir), templates_df(spark), standins.thinking_evaluator, "thinker",
                        error_aware=False, thinking="thinking")
    return out.select("item_id", "dimension", "model", "score", "thinking")


@query("evaluate", ERR_BASE + f""", ep AS (
  SELECT q.item_id, q.dimension, {_error_fill()} AS prompt FROM qald q
  JOIN tpl t ON t.kind = 'error' AND t.dimension = q.dimension)
SELECT item_id, dimension, 'rule' AS model, CAST(1 + length(prompt) % 3 AS INTEGER) AS score FROM ep""")
def q_evaluate(spark, sf_dir):
    from . import jobs
    lab = lab_view(spark, sf_dir).select(F.col("item_id").alias("doc_id"), "error_label")
    qa = qa_view(spark, sf_dir).join(lab, "doc_id", "left")
    out = jobs.evaluate(qa, templates_df(spark), standins.length_rule_evaluator, "rule")
    return out.select("item_id", "dimension", "model", "score")


COMPARE_SQL = V.with_views(V.RESP) + f""", bm AS (
  SELECT item_id, dimension, model, rating, 'vanilla' AS mode, {V.extract_score('response')} AS score FROM resp
  UNION ALL
  SELECT item_id, dimension, model, rating, 'error' AS mode,
         {V.extract_score("CASE WHEN item_id % 3 = 0 THEN 'score: ' || CAST(CAST(rating AS INTEGER) AS VARCHAR) ELSE response END")} FROM resp)
, pr AS (SELECT mode, dimension, model, CAST(count(*) AS BIGINT) AS n,
           round(CASE WHEN stddev_pop(rating) * stddev_pop(score) = 0 THEN NULL
                 ELSE covar_pop(rating, score) / (stddev_pop(rating) * stddev_pop(score)) END, 6) AS r
         FROM bm WHERE score <> 999 GROUP BY mode, dimension, model)
SELECT dimension, model,
  max(n) FILTER (WHERE mode = 'vanilla') AS vanilla_n, max(r) FILTER (WHERE mode = 'vanilla') AS vanilla_r,
  max(n) FILTER (WHERE mode = 'error') AS error_n, max(r) FILTER (WHERE mode = 'error') AS error_r
FROM pr GROUP BY dimension, model"""


@query("compare_modes", COMPARE_SQL)
def q_compare_modes(spark, sf_dir):
    from ..operators import rows
    from . import jobs
    r = views.responses(spark, sf_dir)
    err_resp = F.when(F.col("item_id") % 3 == 0, F.concat(
        F.lit("score: "), F.col("rating").cast("int").cast("string"))).otherwise(F.col("response"))
    # one scan: each row fans out to its modes, the rating rides along
    modes = F.array(F.struct(F.lit("vanilla").alias("mode"), F.col("response")),
                    F.struct(F.lit("error").alias("mode"), err_resp.alias("response")))
    both = r.select("item_id", "dimension", "model", "rating", F.explode(modes).alias("m"))
    scored = rows.with_score(both.select("item_id", "dimension", "model", "rating", "m.*")).drop("response")
    return jobs.compare_modes(scored)


def _training_set_sql() -> str:
    """The whole loop with the stand-ins written out: from the second attempt on
    every prompt gets a reply with the labels of its evidence lines, so an item is
    accepted if those equal the example's labels; reviewers hash their prompt."""
    prompt = V.fill("(SELECT body FROM tpl WHERE kind = 'generate')",
                    [("{{FEW_SHOT_EXAMPLES}}", FEW_SHOT_SQL_EXPR.format(p="ex_")),
                     ("{{ERROR}}", V.describe(V.parse_labels("ex_error_label"))),
                     ("{{PASSAGE}}", "passage"), ("{{ANSWER}}", "answer")])
    review = V.fill("(SELECT body FROM tpl WHERE kind = 'review')",
                    [("{{PASSAGE}}", "passage"), ("{{ANSWER}}", "answer"), ("{{QUESTION}}", "question"),
                     ("{{ERROR}}", "error_label")])

    def lowered(e):
        return f"list_transform({e}, lambda x: lower(x))"

    def confidence(name):
        h = f"CAST(('0x' || substr(md5('{name}|' || review), 1, 8)) AS BIGINT)"
        return f"CAST(printf('%.2f', ({h} % 101) / 100.0) AS DOUBLE)"

    raw, got = V.parse_labels_raw("ex_error_label"), V.parse_labels_raw("error_label")
    votes = " + ".join(f'CASE WHEN "check-{r}" >= thres THEN 1 ELSE 0 END' for r in vocab.REVIEWERS)
    return DRAW_SQL + ", " + _tpl_sql() + f"""
, sx AS (SELECT sh.item_id, sh.passage, sh.answer, q.source, e.passage AS ex_passage, e.answer AS ex_answer,
                e.question AS ex_question, e.error_label AS ex_error_label
         FROM shot sh JOIN seed e ON e.item_id = sh.ex_item_id JOIN qa q ON q.item_id = sh.item_id)
, gen AS (SELECT item_id, passage, answer, split_part(source, '_', 1) || '_GPT-4' AS source, ex_error_label,
                 'What is said about item ' || CAST(length({prompt}) % 97 AS VARCHAR) || '?' AS question,
                 array_to_string({V.parse_labels("ex_error_label")}, '; ') AS error_label FROM sx)
, acc AS (SELECT * FROM gen WHERE error_label <> '' AND len({raw}) = len({got})
          AND list_sort(list_distinct({lowered(raw)})) = list_sort(list_distinct({lowered(got)})))
, rp AS (SELECT *, {review} AS review FROM acc)
, rv AS (SELECT *, {", ".join(f'{confidence(r)} AS "check-{r}"' for r in vocab.REVIEWERS)},
                CASE WHEN list_has_any({got}, {V.list_lit(vocab.LOW_PRECISION_LABELS)})
                     THEN {vocab.LOW_PRECISION_THRESHOLD} ELSE 0.5 END AS thres FROM rp)
SELECT item_id, passage, answer, question, source, error_label, {", ".join(f'"check-{r}"' for r in vocab.REVIEWERS)}
FROM rv WHERE {votes} >= {vocab.DEFAULT_VOTES}"""


@query("build_training_set", _training_set_sql())
def q_build_training_set(spark, sf_dir):
    from . import jobs
    seeds = seed_view(spark, sf_dir).select("item_id", "passage", "answer", "question", "error_label")
    cands = qa_view(spark, sf_dir).select("item_id", "passage", "answer", "source")
    reviewers = {r: standins.hashed_reviewer(r) for r in vocab.REVIEWERS}
    return jobs.build_training_set(
        cands, seeds, templates_df(spark), standins.label_echo_generator, reviewers,
        vocab.DEFAULT_DIFFICULTY, vocab.DEFAULT_IMPORTANCE, vocab.LOW_PRECISION_LABELS,
        threshold=0.5, by="threshold")


@query("train_dev_split_exact", V.with_views(V.LAB) + f"""
, rk AS (SELECT item_id, row_number() OVER (ORDER BY {V.md5_u32(vocab.SPLIT_SEED, 'item_id')}, item_id) AS r FROM lab)
SELECT item_id, CASE WHEN r <= ceil((SELECT count(*) FROM lab) * {vocab.IDENTIFIER_DEV_SHARE} / 100.0)
                     THEN 'dev' ELSE 'train' END AS split FROM rk""")
def q_train_dev_split_exact(spark, sf_dir):
    from ..operators import sampling as S
    return S.train_dev_split_exact(lab_view(spark, sf_dir)).select("item_id", "split")



@query("uniform_few_shot", DRAW_SQL + f"""
, useed AS (SELECT item_id AS ex_item_id,
                   row_number() OVER (ORDER BY {V.md5_u32(vocab.SPLIT_SEED, 'item_id')}, item_id) - 1 AS slot FROM seed)
SELECT q.item_id, u.ex_item_id FROM qa q JOIN useed u
  ON u.slot = {V.md5_u32(vocab.SPLIT_SEED, "'shot'", 'q.item_id')} % (SELECT count(*) FROM seed)""")
def q_uniform_few_shot(spark, sf_dir):
    """One uniformly chosen seed example per candidate (no label targeting)."""
    from ..operators import sampling as S
    return S.uniform_few_shot(qa_view(spark, sf_dir).select("item_id"), seed_table(spark, sf_dir)) \
        .select("item_id", "ex_item_id")


POS_WEIGHT = [1.0, 2.0, 2.0, 2.0, 3.0, 1.0, 1.0, 1.5, 1.5, 1.5, 0.5]


def sql_bce_weighted(x: str, y: str, w: str) -> str:
    return f"((1.0 - {y}) * {x} + (1.0 + ({w} - 1.0) * {y}) * (greatest(-{x}, 0.0) + ln(1 + exp(-abs({x})))))"


@query("bce_loss_weighted", ML_SQL + f"""
, el AS (SELECT {sql_bce_weighted('logits[i + 1]', 'CAST(y_true[i + 1] AS DOUBLE)', f'{POS_WEIGHT}[i + 1]')} AS l
         FROM ml, range(0, {len(vocab.LABELS)}) t(i))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM ml) AS n, round(avg(l), 6) AS bce_mean, round(sum(l), 6) AS bce_sum FROM el""")
def q_bce_loss_weighted(spark, sf_dir):
    """Sigmoid cross-entropy with a per-label positive weight."""
    return metrics.bce_loss(prediction_table(spark, sf_dir), pos_weight=POS_WEIGHT)



@query("resume_scoring", "WITH dp AS (" + _direct_prompt_sql() + ")\n" +
       "SELECT item_id, dimension, 'rule' AS model, CAST(1 + length(prompt) % 3 AS INTEGER) AS score FROM dp")
def q_resume_scoring(spark, sf_dir):
    """The first run covers three dimensions with a model that fails for some
    prompts; the rerun scores the rest and asks the failed ones again."""
    from ..operators import prompts
    from . import jobs
    x = prompts.all_dimensions(qa_view(spark, sf_dir))
    req = prompts.with_messages(prompts.render_prompt(x, templates_df(spark))) \
        .withColumn("model", F.lit("rule")).select("item_id", "dimension", "model", "messages")
    sink = _scratch(spark, "resume")
    jobs.resume_scoring(req.filter(F.col("dimension").isin(vocab.DIMENSIONS[:3])), sink,
                        standins.failing_evaluator)
    out = jobs.resume_scoring(req, sink, standins.length_rule_evaluator)
    return out.select("item_id", "dimension", "model", "score")


@query("score_in_stream", "WITH dp AS (" + _direct_prompt_sql() + ")\n" +
       "SELECT item_id, dimension, 'rule' AS model, CAST(1 + length(prompt) % 3 AS INTEGER) AS score, "
       "CAST(1 AS BIGINT) AS n_replies FROM dp")
def q_score_in_stream(spark, sf_dir):
    """Requests in three files, scored in three micro-batches by a model that
    fails for some prompts; the queue is asked again, one reply per key."""
    from ..operators import prompts
    from ..streaming import scoring
    x = prompts.all_dimensions(qa_view(spark, sf_dir))
    req = prompts.with_messages(prompts.render_prompt(x, templates_df(spark))) \
        .withColumn("model", F.lit("rule")).select("item_id", "dimension", "model", "messages")
    source, sink, check = (_scratch(spark, n) for n in ("requests", "replies", "stream"))
    req.repartition(3).write.parquet(source)
    scoring.run_scoring(spark, source, sink, check, standins.failing_evaluator, max_files_per_trigger=1, max_tries=9)
    scoring.retry_failed(spark, sink, standins.length_rule_evaluator)
    got = scoring.ScoringSink(spark, sink).replies()
    return got.groupBy("item_id", "dimension", "model").agg(F.max("score").alias("score"),
                                                            F.count(F.lit(1)).alias("n_replies"))


def _registry_views():
    from .registry import ORACLE, QUERIES
    return QUERIES, ORACLE


QUERIES_FOR_TESTS, ORACLE_FOR_TESTS = _registry_views()
