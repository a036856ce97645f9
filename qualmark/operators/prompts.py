"""Prompt rendering as column expressions over (row x dimension) tables.

Templates form a tiny table ``(kind, dimension, body)`` — one row per kind and
dimension — that is broadcast into the join. Rows are fanned out to
dimensions with ``explode`` (a narrow generator, no join), and prompts are
rendered last so the wide passage column is never shuffled more than needed.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions import text as tx
from ..functions.labels import parse_labels, parse_labels_raw

TEMPLATE_ROOT = os.path.join(os.path.dirname(os.path.dirname(__file__)), "templates")
KIND_DIRS = {"direct": "direct", "error": "error", "identify": "identify",
             "review": "review", "generate": "generate"}
ANY = "any"

TEMPLATE_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("dimension", T.StringType(), False),
    T.StructField("body", T.StringType(), False),
])


def template_rows(root: str = TEMPLATE_ROOT) -> list[tuple[str, str, str]]:
    """(kind, dimension, body) for every template file under ``root``."""
    rows = []
    for kind in sorted(KIND_DIRS):
        d = os.path.join(root, KIND_DIRS[kind])
        if not os.path.isdir(d):
            continue
        for fn in sorted(os.listdir(d)):
            if fn.endswith(".txt"):
                with open(os.path.join(d, fn), encoding="utf-8") as f:
                    rows.append((kind, fn[:-4], f.read()))
    return rows


def packaged_templates(spark: SparkSession, root: str = TEMPLATE_ROOT) -> DataFrame:
    """Template table built from the package's files (about 20 small rows)."""
    return spark.createDataFrame(template_rows(root), TEMPLATE_SCHEMA)


# ---- fan-out and lookups ---------------------------------------------------

def all_dimensions(df: DataFrame, dimensions: Sequence[str] = vocab.DIMENSIONS,
                   col: str = "dimension") -> DataFrame:
    """Each row once per dimension (``explode`` of a literal array)."""
    unknown = set(dimensions) - set(vocab.DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    return df.withColumn(col, F.explode(F.array(*[F.lit(d) for d in dimensions])))


PARSED = "_labels"


def with_parsed_labels(df: DataFrame, label_col: str = "error_label") -> DataFrame:
    """Adds the parsed labels, so that they are parsed once per row and not
    again for every dimension a row is fanned out to."""
    return df.withColumn(PARSED, parse_labels(F.col(label_col)))


def relevant_errors(labels: Column, dimension: Column) -> Column:
    """Parsed labels relevant to the dimension, in identified order with
    duplicates kept."""
    rel = vocab.relevant_labels_for(dimension)
    return F.filter(labels, lambda x: F.array_contains(rel, x))


def describe_errors(labels: Column) -> Column:
    """Evidence lines of the labels joined by newlines (unknown ones skipped)."""
    lines = F.transform(labels, lambda x: F.try_element_at(vocab.description_map(), x))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def attach_template(df: DataFrame, templates: DataFrame, kind: str,
                    dimension_col: str | None = "dimension") -> DataFrame:
    """Join the template body for ``kind`` (and the row's dimension). Of several
    rows for a kind and dimension the body that sorts first is taken, so at most
    one row per known dimension is broadcast, whatever table is given."""
    t = templates.filter(F.col("kind") == kind)
    if dimension_col is None:
        t = t.filter(F.col("dimension") == ANY).select(F.col("body").alias("template"))
        # one row: attach it as a scalar subquery, not as a join
        return df.withColumn("template", t.scalar())
    t = (t.filter(F.col("dimension").isin(vocab.DIMENSIONS)).groupBy(F.col("dimension").alias(dimension_col))
         .agg(F.min("body").alias("template")))
    return df.join(F.broadcast(t), dimension_col, "inner")


# ---- renderers ---------------------------------------------------------------

QA_SLOTS = ("#passage", "#answer", "#question")


def _qa_slots(passage="passage", answer="answer", question="question"):
    return [("#passage", F.col(passage)), ("#answer", F.col(answer)),
            ("#question", F.col(question))]


def render_prompt(df: DataFrame, templates: DataFrame, out_col: str = "prompt") -> DataFrame:
    """Direct prompt per (row, dimension)."""
    x = attach_template(df, templates, "direct")
    return x.withColumn(out_col, tx.fill_slots(F.col("template"), _qa_slots())).drop("template")


def render_error_prompt(df: DataFrame, templates: DataFrame, label_col: str = "error_label",
                        out_col: str = "prompt", keep_empty_slot: bool = False) -> DataFrame:
    """Error-aware prompt: direct slots, then ``#error`` <- evidence lines of
    the identified labels relevant to the dimension.

    The labels are taken from ``with_parsed_labels`` if that was applied before
    the fan-out. ``keep_empty_slot`` leaves ``#error`` in place when the label
    string is empty (the behaviour of a remote-evaluator path)."""
    if PARSED not in df.columns:
        df = with_parsed_labels(df, label_col)
    x = attach_template(df, templates, "error")
    evidence = describe_errors(relevant_errors(F.col(PARSED), F.col("dimension")))
    filled = tx.fill_slots(F.col("template"), _qa_slots() + [("#error", evidence)])
    if keep_empty_slot:
        partial = tx.fill_slots(F.col("template"), _qa_slots())
        filled = F.when(F.coalesce(F.col(label_col), F.lit("")) == "", partial).otherwise(filled)
    return x.withColumn(out_col, filled).drop("template", PARSED)


def with_messages(df: DataFrame, prompt_col: str = "prompt", out_col: str = "messages",
                  system_text: str = vocab.SYSTEM_EVALUATOR) -> DataFrame:
    return df.withColumn(out_col, tx.build_messages(system_text, F.col(prompt_col)))


def render_batch(df: DataFrame, templates: DataFrame, error_aware: bool,
                 dimensions: Sequence[str] = vocab.DIMENSIONS,
                 label_col: str = "error_label") -> DataFrame:
    """Rows x dimensions -> ``messages``; the error-aware path fills NULL
    strings with ``''`` and parses the labels before the fan-out."""
    if error_aware:
        from .rows import fill_empty
        x = all_dimensions(with_parsed_labels(fill_empty(df), label_col), dimensions)
        x = render_error_prompt(x, templates, label_col)
    else:
        x = render_prompt(all_dimensions(df, dimensions), templates)
    return with_messages(x).drop("prompt")


def render_identify_prompt(df: DataFrame, templates: DataFrame,
                           out_col: str = "prompt") -> DataFrame:
    x = attach_template(df, templates, "identify", None)
    return x.withColumn(out_col, tx.fill_slots(F.col("template"), _qa_slots())).drop("template")


def render_review_prompt(df: DataFrame, templates: DataFrame, label_col: str = "error_label",
                         out_col: str = "prompt") -> DataFrame:
    x = attach_template(df, templates, "review", None)
    slots = [("{{PASSAGE}}", F.col("passage")), ("{{ANSWER}}", F.col("answer")),
             ("{{QUESTION}}", F.col("question")), ("{{ERROR}}", F.col(label_col))]
    return x.withColumn(out_col, tx.fill_slots(F.col("template"), slots)).drop("template")


def render_generation_prompt(df: DataFrame, templates: DataFrame, prefix: str = "ex_",
                             out_col: str = "prompt") -> DataFrame:
    """Generation prompt from a candidate row and its attached example
    (``ex_*`` columns). Also returns ``target_labels``: the example's label
    tokens, which the generated question must carry."""
    x = attach_template(df, templates, "generate", None)
    ex_label = F.col(prefix + "error_label")
    block = tx.few_shot_block(F.col(prefix + "passage"), F.col(prefix + "answer"),
                              F.col(prefix + "question"), ex_label)
    targets = parse_labels_raw(ex_label)
    slots = [("{{FEW_SHOT_EXAMPLES}}", block), ("{{ERROR}}", describe_errors(parse_labels(ex_label))),
             ("{{PASSAGE}}", F.col("passage")), ("{{ANSWER}}", F.col("answer"))]
    return (x.withColumn(out_col, tx.fill_slots(F.col("template"), slots))
            .withColumn("target_labels", targets).drop("template"))


def identifier_text(question: Column, answer: Column, passage: Column,
                    model_type: str = "roberta") -> Column:
    return tx.join_parts([question, answer, passage], vocab.sep_token(model_type))


def identifier_text_of(question: str | None, answer: str | None, passage: str | None,
                       model_type: str = "roberta") -> str | None:
    """``identifier_text`` of one row, without Spark."""
    parts = (question, answer, passage)
    return None if None in parts else vocab.sep_token(model_type).join(parts)


def verifier_text(labels: Column, question: Column, answer: Column, passage: Column,
                  model_type: str = "roberta") -> Column:
    return tx.join_parts([labels, question, answer, passage], vocab.sep_token(model_type))


CHAT_BLOCK = 256  # turns concatenated per partial transcript


def chat_transcripts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                     role: str = "role", text: str = "text",
                     add_generation_prompt: bool = True) -> DataFrame:
    """One rendered transcript per conversation (turns ordered by number).

    Each turn is rendered on its own row (narrow). Pieces are then joined in
    two levels: per (conversation, block of 256 turns), then the few block
    strings per conversation. A very long conversation is therefore spread
    over many tasks; only its final string is one row, since it is the
    output."""
    from .. import vocab
    piece = F.concat(F.lit(vocab.CHAT_HEADER_START), F.col(role), F.lit(vocab.CHAT_HEADER_END),
                     tx.ustrip(F.col(text)), F.lit(vocab.CHAT_TURN_END))
    p = turns.select(conv, F.col(turn).alias("_t"), piece.alias("_p"),
                     F.floor(F.col(turn) / CHAT_BLOCK).alias("_blk"))
    blocks = p.groupBy(conv, "_blk").agg(
        F.array_sort(F.collect_list(F.struct("_t", "_p"))).alias("_s"))
    blocks = blocks.select(conv, "_blk", F.array_join(F.transform("_s", lambda e: e["_p"]), "")
                           .alias("_txt"))
    whole = blocks.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct("_blk", "_txt"))).alias("_s"))
    body = F.array_join(F.transform("_s", lambda e: e["_txt"]), "")
    parts = [F.lit(vocab.CHAT_BEGIN), body]
    if add_generation_prompt:
        parts.append(F.lit(vocab.CHAT_HEADER_START + "assistant" + vocab.CHAT_HEADER_END))
    return whole.select(conv, F.concat(*parts).alias("chat"))
