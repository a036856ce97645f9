"""Inputs derived from the shared test tables (see FIXTURES.md §2).

Each builder reads only the columns it needs from ``sf_dir`` so the parquet
scan is pruned. None of these collects anything to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from .tables import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


_read = table


def _dimension_of(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in vocab.DIMENSIONS]), idx.cast("int") + 1)


def qa_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-QA: a user turn and the next assistant turn, with the document of
    the conversation as passage. ``item_id = conv_id*100 + turn``."""
    conv = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))
    answers = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    docs = _read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("passage"), "source")
    return (users.join(answers, ["conv_id", "turn"])
            .join(docs, "conv_id")
            .select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"),
                    "passage", "question", "answer", "source",
                    F.col("conv_id").alias("doc_id")))


#: Further labels by a divisor of doc_id: with them every vocabulary label, an
#: alias spelling and a repeated label occur.
RARE_LABELS = ((23, "Incomplete;Incomplete"), (29, "Not A Question"), (31, "Not a Question"),
               (37, "Spell Error "), (41, "Grammatical Error"), (43, "Unnecessary Copy from Passage"),
               (47, "Information Not Mentioned"), (53, " Off Target Answer"), (59, "Grammar Error"))


def _label_string(doc_id: Column) -> Column:
    none_of = (doc_id % 5 != 0) & (doc_id % 7 != 0) & (doc_id % 11 != 0)
    return F.concat_ws(
        ";",
        F.when(doc_id % 5 == 0, F.lit(" Vague")),
        F.when(doc_id % 7 == 0, F.lit("Off Topic ")),
        F.when(doc_id % 11 == 0, F.lit("Factual Error")),
        F.when(doc_id % 13 == 0, F.lit("Bogus Label")),
        F.when(doc_id % 17 == 0, F.lit("")),
        F.when(none_of, F.lit("No Error")),
        *[F.when(doc_id % n == 0, F.lit(text)) for n, text in RARE_LABELS],
    )


def labeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-LAB: ``(item_id, error_label)`` of every document; the label is NULL
    where ``doc_id % 19 = 0``."""
    d = _read(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.col("doc_id").alias("item_id"),
                    F.when(F.col("doc_id") % 19 != 0, _label_string(F.col("doc_id"))).alias("error_label"))


def labeled_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-QA rows with the V-LAB label of their document, NULL labels included."""
    lab = labeled_docs(spark, sf_dir).select(F.col("item_id").alias("doc_id"), "error_label")
    return qa_items(spark, sf_dir).join(lab, "doc_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-RESP: one evaluator response per event, in five reply styles, plus a
    human rating. Columns item_id, dimension, model, response, rating."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    eid = F.col("event_id")
    s = (eid % 3 + 1).cast("string")
    style = eid % 5
    odd = F.floor(eid / 5) % 12  # rarer forms, spread over the styles
    response = (F.when(odd == 7, F.concat(F.lit("score:\u00a0"), s))
                .when(odd == 8, F.concat(F.lit("Score\u3000: "), s, F.lit(".5 of 3")))
                .when(odd == 9, F.lit("score: 99999999999"))
                .when(odd == 10, F.concat(F.lit("SCORE : "), s, F.lit(" not score: 9")))
                .when(style == 0, F.concat(F.lit("score: "), s, F.lit("  \nreason: x")))
                .when(style == 1, F.concat(F.lit("A Score of "), s))
                .when(style == 2, F.concat(F.lit("Assign a Score:\nScore "), s, F.lit(": ok")))
                .when(style == 3, F.concat(F.lit("**Score:** "), s))
                .otherwise(F.lit("")))
    rating = F.when(eid % 4 == 0, F.floor(F.col("value")) % 3 + 1).otherwise(eid % 3 + 1)
    return e.select(
        eid.alias("item_id"),
        _dimension_of(eid % 7).alias("dimension"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        response.alias("response"),
        rating.cast("double").alias("rating"),
    )


def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-REV (wide): three reviewer confidences per document with its label."""
    d = _read(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    a = ((k * 37) % 101).cast("double") / F.lit(100.0)
    b = ((k * 53 + 20) % 101).cast("double") / F.lit(100.0)
    c = ((k * 71 + 40) % 101).cast("double") / F.lit(100.0)
    return d.select(
        k.alias("item_id"),
        _label_string(k).alias("error_label"),
        F.when(k % 11 != 0, a).alias("check-gemini"),
        b.alias("check-gpt"),
        c.alias("check-claude"),
    )


def review_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-REV in long form: ``(item_id, reviewer, response)`` with the reply as
    text (as a reviewer would send it); missing replies are ``n/a``."""
    w = review_scores(spark, sf_dir)
    cols = [F.struct(F.lit(r).alias("reviewer"), F.col(f"`check-{r}`").alias("v"))
            for r in vocab.REVIEWERS]
    x = w.select("item_id", F.explode(F.array(*cols)).alias("r"))
    text = F.when(F.col("r.v").isNull(), F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), F.format_number(F.col("r.v"), 2), F.lit("\n")))
    return x.select("item_id", F.col("r.reviewer").alias("reviewer"), text.alias("response"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-LOGIT + V-TRUE: 11 logits (first 11 embedding values x 20) and the
    true label set (vocabulary entries at ``label`` and ``(label+vec_id%3)%11``)."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    lg = F.transform(F.slice(F.col("embedding"), 1, len(vocab.LABELS)),
                     lambda x: x.cast("double") * F.lit(20.0))
    voc = vocab.vocab_array()
    t1 = F.element_at(voc, F.col("label") + 1)
    t2 = F.element_at(voc, ((F.col("label") + F.col("vec_id") % 3) % 11).cast("int") + 1)
    return e.select(F.col("vec_id").alias("item_id"), lg.alias("logits"),
                    F.array(t1, t2).alias("true_labels"))


def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-BIN: truth ``quality``, prediction ``toxic``."""
    return _read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.col("quality").cast("int").alias("label"),
        F.col("toxic").cast("int").alias("pred"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-GEN: a generator reply per document in five styles (clean JSON, fenced
    JSON, single-quoted JSON, JSON with chatter behind it, broken text) plus its
    target labels."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "source")
    k = F.col("doc_id")
    q = F.concat(F.lit("What does document "), k.cast("string"), F.lit(" say about "),
                 F.col("source"), F.lit("?"))
    lab = _label_string(k)
    dq = F.concat(F.lit('{"question": "'), q, F.lit('", "error_label": "'), lab, F.lit('"}'))
    sq = F.concat(F.lit("{'question': '"), q, F.lit("', 'error_label': '"), lab, F.lit("'}"))
    style = k % 5
    resp = (F.when(style == 0, dq)
            .when(style == 1, F.concat(F.lit("```json\n"), dq, F.lit("\n```")))
            .when(style == 2, sq)
            .when(style == 3, F.concat(dq, F.when(k % 2 == 0, F.lit(" Hope this helps!"))
                                       .otherwise(F.concat(F.lit(" or "), dq))))
            .otherwise(F.concat(F.lit("no json here "), k.cast("string"))))
    return d.select(k.alias("item_id"), resp.alias("response"), lab.alias("target_label"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-CHAT source rows: ``(conv_id, turn, role, text)``."""
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
