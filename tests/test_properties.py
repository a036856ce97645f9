"""Properties against brute-force Python on generated inputs."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualmark import vocab
from qualmark.functions import labels as lb
from qualmark.functions import parse as P
from qualmark.operators import sampling as S

SETTINGS = settings(max_examples=5, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def py_score(text):
    """Brute force of the score rule: first pattern (in order) with a match
    decides; ASCII digits, blanks of any script; out-of-int-range -> 999."""
    if not text:
        return vocab.NO_SCORE
    for pat in vocab.SCORE_PATTERNS:
        m = re.search(pat.replace(r"\d", "[0-9]"), text, re.IGNORECASE)
        if m:
            v = int(m.group(1))
            return v if v <= 2**31 - 1 else vocab.NO_SCORE
    return vocab.NO_SCORE


PIECES = ["score", "Score", "SCORE", ":", " ", "\n", "\t", "of", " of ", "1", "2", "3", "42",
          "99999999999", "Assign a Score", "reason", "**", "x", "٣", "\u00a0", "\u3000", "\x1c"]
texts = st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join),
                 min_size=1, max_size=40)


@SETTINGS
@given(texts)
def test_score_matches_brute_force(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(P.extract_score(F.col("v"))).collect()]
    assert got == [py_score(v) for v in values]


LABEL_PIECES = vocab.LABELS + ["Grammatical Error", "Bogus", "", " ", "\t", ";", "; "]
label_strings = st.lists(st.lists(st.sampled_from(LABEL_PIECES), max_size=8).map("".join),
                         min_size=1, max_size=30)


@SETTINGS
@given(label_strings)
def test_label_parsing_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(lb.parse_labels_raw(F.col("v")), lb.parse_labels(F.col("v"))).collect()
    for v, (raw, parsed) in zip(values, rows):
        toks = [t.strip() for t in v.split(";")]
        assert raw == toks
        canon = [vocab.LABEL_ALIASES.get(t, t) for t in toks]
        assert parsed == [t for t in canon if t in vocab.LABELS]


def md5_u32(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


weights = st.lists(st.floats(min_value=0.0, max_value=5.0), min_size=1, max_size=8).filter(
    lambda w: sum(w) > 0)


@SETTINGS
@given(weights)
def test_weighted_draw_matches_brute_force(spark, ws):
    labels = [f"L{i}" for i in range(len(ws))]
    total = sum(ws)
    norm = [w / total for w in ws]
    wdf = spark.createDataFrame(list(zip(labels, norm)), "label string, final_weight_norm double")
    cands = spark.range(0, 300).withColumnRenamed("id", "item_id")
    got = {r.item_id: r.sampled_label for r in S.weighted_label_sample(cands, wdf).collect()}
    # brute force: cumulative bounds in label order, last upper bound forced to 1
    bounds, acc = [], 0.0
    for i, (lab, w) in enumerate(zip(labels, norm)):
        lo, acc = acc, acc + w
        bounds.append((lab, lo, 1.0 if i == len(labels) - 1 else acc))
    for k in range(300):
        u = md5_u32(vocab.SPLIT_SEED, k) / 4294967296.0
        expect = next(lab for lab, lo, hi in bounds if lo <= u < hi and hi > lo)
        assert got[k] == expect


def test_slots_match_plain_ranking_under_skew(spark):
    # one group holds ~90% of the rows
    rows = [(i, "hot" if i % 10 else f"g{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "item_id long, g string")
    got = {(r.g, r.item_id): r.slot for r in S.slot_tables(df, "g", "item_id")[0].collect()}
    by_group = {}
    for k, g in rows:
        by_group.setdefault(g, []).append(k)
    for g, keys in by_group.items():
        order = sorted(keys, key=lambda k: (md5_u32(vocab.SPLIT_SEED, k), k))
        for slot, k in enumerate(order):
            assert got[(g, k)] == slot


def test_chat_blocks_keep_turn_order(spark):
    from qualmark.functions import text as tx
    from qualmark.operators import prompts
    n = 600  # spans three 256-turn blocks
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f" m{t} ") for t in range(n)][::-1]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prompts.chat_transcripts(df).first().chat
    msgs = spark.createDataFrame([([(r, c) for _, _, r, c in sorted(rows, key=lambda x: x[1])],)],
                                 "m array<struct<role:string,content:string>>")
    expect = msgs.select(tx.render_chat(F.col("m"))).first()[0]
    assert got == expect


def _weights(spark, pairs):
    return spark.createDataFrame(pairs, "label string, final_weight_norm double")


def test_few_shot_with_hot_label(spark):
    seeds = spark.createDataFrame(
        [(i, f"p{i}", f"a{i}", f"q{i}", "Vague" if i < 3 else "Off Topic; Spell Error") for i in range(40)],
        "item_id long, passage string, answer string, question string, error_label string")
    cands = spark.range(0, 5000).withColumnRenamed("id", "item_id")
    drawn = S.weighted_label_sample(cands, _weights(spark, [("Off Topic", 0.005), ("Spell Error", 0.005),
                                                            ("Vague", 0.99)]))
    out = S.attach_few_shot(drawn, seeds).collect()
    assert len(out) == 5000 and len({r.item_id for r in out}) == 5000
    for r in out:
        assert r.sampled_label in [t.strip() for t in r.ex_error_label.split(";")]
    hot = [r for r in out if r.sampled_label == "Vague"]
    assert len(hot) > 4800 and {r.ex_item_id for r in hot} == {0, 1, 2}


def test_shuffle_path_equals_broadcast_path(spark):
    w = _weights(spark, [(f"L{i}", 1.0 / 50) for i in range(50)])
    cands = spark.range(0, 2000).withColumnRenamed("id", "item_id")
    seeds = spark.createDataFrame([(i, f"L{i % 50}") for i in range(500)], "item_id long, error_label string")
    a = {(r.item_id, r.sampled_label, r.ex_item_id)
         for r in S.attach_few_shot(S.weighted_label_sample(cands, w), seeds).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        d = S.attach_few_shot(S.weighted_label_sample(cands, w), seeds)
        b = {(r.item_id, r.sampled_label, r.ex_item_id) for r in d.collect()}
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert a == b and len(a) == 2000
