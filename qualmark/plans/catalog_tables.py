"""Registered queries over growing tables: reviews of unknown reviewers (J6) and
vocabularies in versions (J1, J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import prompts, vocabulary, voting
from ..session import scratch_path
from ..sources import views
from . import catalog as C
from . import sqlviews as V
from .registry import query


# ---- J6 -------------------------------------------------------------------------

def _grown_reviews(spark, sf_dir) -> str:
    """A folder of review tables: the first run has three reviewers for every
    third item and two for the others; the second one asks gpt again for some and
    has a fourth reviewer, whose replies are text."""
    root = scratch_path(spark, "reviews")
    r = views.review_scores(spark, sf_dir).drop("error_label")
    third = F.col("item_id") % 3 == 0
    first = r.withColumn("check-gemini", F.when(third, F.col("`check-gemini`")))
    first.write.parquet(f"{root}/run=1")
    again = F.when(F.col("item_id") % 4 == 0, 1 - F.col("`check-gpt`"))
    fourth = F.when(third, F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" 0."), (F.col("item_id") % 10).cast("string")))
                    .otherwise("n/a"))
    second = r.select("item_id", again.alias("check-gpt"), fourth.alias("check-mistral"))
    second.write.parquet(f"{root}/run=2")
    return root


GROWN_SQL = V.with_views(V.REV) + """, said AS (
  SELECT item_id, 'gemini' AS reviewer, CASE WHEN item_id % 3 = 0 THEN "check-gemini" END AS c FROM rev
  UNION ALL SELECT item_id, 'gpt', CASE WHEN item_id % 4 = 0 THEN 1 - "check-gpt" ELSE "check-gpt" END FROM rev
  UNION ALL SELECT item_id, 'claude', "check-claude" FROM rev
  UNION ALL SELECT item_id, 'mistral', CASE WHEN item_id % 6 = 0 THEN CAST('0.' || (item_id % 10) AS DOUBLE) END FROM rev)
, told AS (SELECT * FROM said WHERE c IS NOT NULL)
"""


@query("review_map", GROWN_SQL + """SELECT item_id, string_agg(reviewer || '=' || printf('%.2f', c), ' ' ORDER BY reviewer) AS reviews,
  CAST(count(*) AS INTEGER) AS n FROM told GROUP BY item_id""")
def q_review_map(spark, sf_dir):
    """The last reply of every reviewer found in the tables."""
    m = voting.review_map(voting.read_reviews(spark, _grown_reviews(spark, sf_dir)))
    told = F.transform(F.map_entries("reviews"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    return m.select("item_id", F.array_join(F.array_sort(told), " ").alias("reviews"), F.size("reviews").alias("n"))


@query("vote_filter_map", GROWN_SQL + f""", need AS (
  SELECT item_id, error_label, CASE WHEN list_has_any({V.parse_labels_raw('error_label')}, {V.list_lit(vocab.LOW_PRECISION_LABELS)})
         THEN {vocab.LOW_PRECISION_VOTES} ELSE {vocab.DEFAULT_VOTES} END AS need FROM rev)
, got AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE c >= 0.4) AS votes FROM told GROUP BY item_id)
SELECT item_id, error_label, CAST(votes AS INTEGER) AS vote, CAST(least(need, greatest(n, 1)) AS INTEGER) AS required_vote
FROM need JOIN got USING (item_id) WHERE votes >= least(need, greatest(n, 1))""")
def q_vote_filter_map(spark, sf_dir):
    """Votes over two, three or four reviewers in one run."""
    m = voting.review_map(voting.read_reviews(spark, _grown_reviews(spark, sf_dir)))
    base = views.review_scores(spark, sf_dir).select("item_id", "error_label").join(m, "item_id", "left")
    return voting.vote_filter_map(base, threshold=0.4, low_precision=vocab.LOW_PRECISION_LABELS, of_present=True,
                                  return_with_score=True).select("item_id", "error_label", "vote", "required_vote")


# ---- J1, J2 ---------------------------------------------------------------------

#: What the second version changes: a label it adds, an alias, and one it takes from clarity.
ADDED = ("Bogus Label", "* Bogus Label -- made up for the second version.")


def two_versions(spark) -> vocabulary.Vocabulary:
    """The package's vocabulary, and a second version of it."""
    a, b = vocabulary.fixed_tables(spark, "v1"), vocabulary.fixed_tables(spark, "v2")
    labels = b.labels.withColumn("description", F.concat(F.lit("v2 "), "description")).unionByName(
        spark.createDataFrame([("v2", 11, *ADDED)], vocabulary.LABEL_SCHEMA))
    relevance = b.relevance.filter("not (dimension = 'clarity' and label = 'Vague')").unionByName(
        spark.createDataFrame([("v2", "fluency", ADDED[0])], vocabulary.RELEVANCE_SCHEMA))
    aliases = spark.createDataFrame([("v2", "Grammatical Error", "Vague")], vocabulary.ALIAS_SCHEMA)
    return vocabulary.Vocabulary(a.labels.unionByName(labels), a.relevance.unionByName(relevance),
                                 a.aliases.unionByName(aliases))


def _versions_sql() -> str:
    names = V.list_lit([*vocab.LABELS, ADDED[0]])
    raw = V.parse_labels_raw("error_label")
    first = V.describe(V.relevant("error_label", "q.dimension"))
    relevant = "(CASE q.dimension " + " ".join(
        f"WHEN {V.lit(d)} THEN {V.list_lit([x for x in names_ if (d, x) != ('clarity', 'Vague')] + [ADDED[0]] * (d == 'fluency'))}"
        for d, names_ in vocab.DIMENSION_LABELS.items()) + " END)"
    text = "(CASE x " + " ".join(f"WHEN {V.lit(n)} THEN {V.lit('v2 ' + vocab.describe_label_line(n))}" for n in vocab.LABELS) + \
        f" WHEN {V.lit(ADDED[0])} THEN {V.lit(ADDED[1])} END)"
    known = (f"list_filter(list_transform({raw}, lambda x: CASE WHEN x = 'Grammatical Error' THEN 'Vague' ELSE x END), "
             f"lambda x: list_contains({names}, x))")
    second = (f"array_to_string(list_transform(list_filter({known}, lambda x: list_contains({relevant}, x)), "
              f"lambda x: {text}), chr(10))")
    join = "FROM qald q JOIN tpl t ON t.kind = 'error' AND t.dimension = q.dimension"
    fill = [V.fill("t.body", C.QA_SLOTS_SQL + [("#error", e)]) for e in (first, second)]
    return C.ERR_BASE + " UNION ALL ".join(
        f"SELECT q.item_id, q.dimension, 'v{i}' AS version, {f} AS prompt {join}" for i, f in enumerate(fill, 1))


@query("versioned_error_prompt", _versions_sql())
def q_versioned_error_prompt(spark, sf_dir):
    """Every row's prompts under two versions of the vocabulary, side by side."""
    path = scratch_path(spark, "vocabulary")
    two_versions(spark).save(path)
    x = prompts.all_dimensions(C.qa_labeled_filled(spark, sf_dir))
    x = x.withColumn("version", F.explode(F.array(F.lit("v1"), F.lit("v2"))))
    out = vocabulary.render_error_prompt(x, C.templates_df(spark), vocabulary.load_vocabulary(spark, path))
    return out.select("item_id", "dimension", "version", "prompt")
