"""Hand-made cases for the traps of the evaluation scheme (FIXTURES §3)."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualmark.functions import labels as lb
from qualmark.functions import parse as P
from qualmark.functions import text as tx


def one_col(spark, values, typ=T.StringType()):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", typ)]))


SCORE_CASES = [
    ("score: 2  \nreason: x", 2),
    ("SCORE\n:\n3", 3),
    ("A score of 2", 2),
    ("Assign a Score:\nScore 1: bad", 1),
    ("Score of 1, then score: 3", 3),
    ("**Score:** 3", 999),
    ("Score: 99999999999999999999", 999),
    ("score: \u0663", 999),
    ("", 999),
    (None, 999),
    ("score: 10", 10),
    ("score: 2.5", 2),
]


def test_extract_score(spark):
    df = one_col(spark, [c for c, _ in SCORE_CASES])
    got = [r[0] for r in df.select(P.extract_score(F.col("v"))).collect()]
    assert got == [e for _, e in SCORE_CASES]


def test_label_strip_and_split(spark):
    df = one_col(spark, ["\t Vague  \n", "", "a;b;", None])
    got = [r[0] for r in df.select(lb.parse_labels_raw(F.col("v"))).collect()]
    assert got == [["Vague"], [""], ["a", "b", ""], None]


def test_parse_labels_vocab_and_alias(spark):
    df = one_col(spark, ["Vague; Bogus;Grammatical Error; Vague"])
    got = df.select(lb.parse_labels(F.col("v"))).first()[0]
    assert got == ["Vague", "Grammar Error", "Vague"]


def test_labels_equal(spark):
    s = T.StructType([T.StructField("a", T.ArrayType(T.StringType())),
                      T.StructField("b", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), (["A"], ["a"]), (["a"], ["a", "a"])], s)
    got = [r[0] for r in df.select(lb.labels_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False]


def test_slot_injection_is_sequential_and_literal(spark):
    s = T.StructType([T.StructField("t", T.StringType()), T.StructField("p", T.StringType()),
                      T.StructField("a", T.StringType())])
    df = spark.createDataFrame([("P:#passage A:#answer", "cost $1 \\ #answer", "x")], s)
    got = df.select(tx.fill_slots(F.col("t"), [("#passage", F.col("p")), ("#answer", F.col("a"))])).first()[0]
    assert got == "P:cost $1 \\ x A:x"


def test_null_slot_gives_null_prompt(spark):
    s = T.StructType([T.StructField("t", T.StringType()), T.StructField("p", T.StringType())])
    df = spark.createDataFrame([("P:#passage", None)], s)
    assert df.select(tx.fill_slots(F.col("t"), [("#passage", F.col("p"))])).first()[0] is None


def test_split_thinking(spark):
    df = one_col(spark, ["a</think>b</think>\nscore: 2", "no marker\n"])
    r, c = P.split_thinking(F.col("v"))
    got = [tuple(x) for x in df.select(r, c).collect()]
    assert got == [("a</think>b", "score: 2"), ("", "no marker")]


def test_parse_confidence(spark):
    df = one_col(spark, [" 0.85\n", "n/a", "NaN", None])
    got = [r[0] for r in df.select(P.parse_confidence(F.col("v"))).collect()]
    assert got == [0.85, None, None, None]


def test_generated_json(spark):
    vals = ['```json\n{"question": "q1", "error_label": "Vague"}\n```',
            "{'question': 'q2', 'error_label': 'Off Topic'}",
            "```\n{\"question\": \"q3\", \"error_label\": \"No Error\"}```",
            "nope", "[1]"]
    df = one_col(spark, vals)
    j = P.parse_generated_json(F.col("v"))
    got = [tuple(r) for r in df.select(j["question"], j["error_label"]).collect()]
    assert got == [("q1", "Vague"), ("q2", "Off Topic"), ("q3", "No Error"), (None, None), (None, None)]


def test_argmax_first_on_ties_and_softmax(spark):
    s = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame([([0.4, 0.4],), ([1.0, 3.0],)], s)
    rows = df.select(lb.argmax(F.col("v")), lb.softmax(F.col("v"))).collect()
    assert rows[0][0] == 0 and rows[1][0] == 1
    p = rows[1][1]
    assert math.isclose(p[1], math.exp(3) / (math.exp(1) + math.exp(3)))


def test_threshold_is_strict(spark):
    s = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame([([0.5] * 11,)], s)
    got = df.select(lb.above(F.col("v"), lb.thresholds(0.5))).first()[0]
    assert got == [0] * 11


def test_binarize_decode_round_trip(spark):
    from qualmark import vocab
    s = T.StructType([T.StructField("v", T.ArrayType(T.StringType()))])
    sets = [["Vague", "Incomplete"], [], ["No Error"], vocab.LABELS]
    df = spark.createDataFrame([(x,) for x in sets], s)
    got = [r[0] for r in df.select(lb.decode(lb.binarize(F.col("v")))).collect()]
    expect = ["; ".join([l for l in vocab.LABELS if l in x]) for x in sets]
    assert got == expect


def test_truncate_tokens(spark):
    df = one_col(spark, ["  a b\tc\n d  ", "x " * 600])
    got = [r[0] for r in df.select(tx.truncate_tokens(F.col("v"), 3)).collect()]
    assert got == ["a b c", "x x x"]


def test_render_chat_trims_content(spark):
    from qualmark import vocab
    s = T.StructType([T.StructField("m", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])
    df = spark.createDataFrame([([("system", " S \n"), ("user", "U")],)], s)
    got = df.select(tx.render_chat(F.col("m"))).first()[0]
    h, e, t = vocab.CHAT_HEADER_START, vocab.CHAT_HEADER_END, vocab.CHAT_TURN_END
    assert got == (vocab.CHAT_BEGIN + h + "system" + e + "S" + t + h + "user" + e + "U" + t
                   + h + "assistant" + e)


def test_identifier_text_separator_and_nulls(spark):
    from qualmark import vocab
    from qualmark.operators import prompts
    assert vocab.sep_token("RoBERTa") == "</s>"
    assert vocab.sep_token("bert") == "[SEP]" and vocab.sep_token("gpt2") == "[SEP]"
    s = T.StructType([T.StructField(c, T.StringType()) for c in ("q", "a", "p")])
    df = spark.createDataFrame([("q?", "a", "p"), ("q?", None, "p")], s)
    got = [r[0] for r in df.select(prompts.identifier_text(F.col("q"), F.col("a"), F.col("p"))).collect()]
    assert got == ["q?</s>a</s>p", None]
