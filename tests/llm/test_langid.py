import numpy as np
import pytest
from corpus_rows import edge, frame, row  # noqa: F401
from pyspark.sql import functions as F

from qualmark.llm import ftrl, langid

PARTS = {"aa": "ka ma ta sa na ra".split(), "bb": "öl ül ßo är ös ün".split(), "cc": "cho chu tchi pch lch".split()}


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        yield " ".join("".join(rng.choice(PARTS[lang], 3)) for _ in range(30)), lang


def test_held_out_accuracy(spark, frame):
    rows = [row(i, t, lang) for i, (t, lang) in enumerate(texts(240))]
    df = frame(rows)
    model = langid.train(df.limit(150).select("text", "lang"))
    got = langid.predict(df, model).join(df.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred = lang").count() >= 235
    assert got.filter("score < 0 or score > 1").count() == 0
    assert (np.abs(model.weights) < 1e-12).mean() > 0.9  # the penalty leaves few weights


def test_edge(edge):
    df, rows = edge
    model = langid.train(df.select("text", "lang"))
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    for key in (1, 2, 3, 19):
        assert (known[key].lang_pred, known[key].score) == ("und", 0.0)
    assert known[4].lang_pred == "en" and known[-3].lang_pred == "en"


def test_copies_are_drawn_once(frame, monkeypatch):
    """A text that stands for most rows of its language takes one place in the sample."""
    rows = [row(i, t, lang) for i, (t, lang) in enumerate(texts(120))]
    rows += [row(1000 + i, rows[0][1], "aa") for i in range(400)]
    seen = []
    fit = langid.Ftrl.fit
    monkeypatch.setattr(langid.Ftrl, "fit", lambda self, x, y, epochs: seen.extend(y) or fit(self, x, y, epochs))
    langid.train(frame(rows).select("text", "lang"), sample_rows=60)
    assert all(6 <= seen.count(y) <= 30 for y in range(3))


def test_no_labels_and_empty_table(spark, frame):
    none = frame([row(1, "text", None)])
    model = langid.train(none.select("text", "lang"))
    assert [tuple(r) for r in langid.predict(none, model).collect()] == [(1, "und", 0.0)]
    assert langid.predict(frame([]), langid.train(frame([]).select("text", "lang"))).collect() == []


def test_held_out_rule(spark):
    import zlib
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_term_counts_by_hand():
    at, n = langid.term_counts("Ab, ab")
    assert n.sum() == 7 + 6 + 5  # " ab ab " in orders 1 to 3
    assert langid.term_counts("12 .,") is None and langid.term_counts(None) is None


def test_document_frequencies_count_every_text(spark):
    df = spark.createDataFrame([("ab",)] * 9 + [("cd",)] * 4 + [(None,), ("1",)], "text string").repartition(3)
    freq, n = langid.document_frequencies(df)
    assert n == 13
    assert {int(x) for x in freq[langid.term_counts("ab")[0]]} <= {9, 13}


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(400, 3))
    labels = np.array([rng.choice(3, p=ftrl.softmax(r)) for r in raw])
    assert ftrl.temperature(raw * 4, labels) == pytest.approx(4, rel=0.35)
    assert ftrl.temperature(raw[:0], labels[:0]) == 1.0


def test_ftrl_step_by_step():
    f = ftrl.Ftrl(3, 2, alpha=0.5, beta=1.0, l1=0.01, l2=0.1)
    f.step(np.array([1]), np.array([2.0]), 1)
    g = 2.0 * np.array([0.5, -0.5])  # softmax of zeros minus the label
    assert np.allclose(f.z[1], g) and np.allclose(f.n[1], g * g)
    want = -np.sign(g) * (np.abs(g) - 0.01) / ((1 + np.abs(g)) / 0.5 + 0.1)
    assert np.allclose(f.weights()[1], want) and not f.weights()[0].any()
