"""Golden values at sf0.01 (FIXTURES §2) and the oracle sweep at sf0.001."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF0001
from test_properties import py_score

from qualmark import vocab
from qualmark.operators import voting as VT
from qualmark.plans import catalog
from qualmark.plans.registry import load_all
from qualmark.sources import views

needs_data = pytest.mark.skipif(not os.path.isdir(SF001), reason="test data missing")


def reply(eid):
    """The reply of an event, by FIXTURES.md."""
    grade = str(eid % 3 + 1)
    rare = {7: "score:\u00a0" + grade, 8: f"Score\u3000: {grade}.5 of 3", 9: "score: 99999999999",
            10: f"SCORE : {grade} not score: 9"}.get(eid // 5 % 12)
    return rare or [f"score: {grade}  \nreason: x", f"A Score of {grade}", f"Assign a Score:\nScore {grade}: ok",
                    f"**Score:** {grade}", ""][eid % 5]


def label_string(k):
    parts = [(5, " Vague"), (7, "Off Topic "), (11, "Factual Error"), (13, "Bogus Label"), (17, "")]
    out = [t for n, t in parts if k % n == 0]
    out += ["No Error"] if k % 5 and k % 7 and k % 11 else []
    return ";".join(out + [t for n, t in views.RARE_LABELS if k % n == 0])


@needs_data
def test_score_and_pearson_golden(spark):
    s = catalog.scored_responses(spark, SF001)
    counts = {r.score: r["count"] for r in s.groupBy("score").count().collect()}
    assert counts == Counter(map(py_score, map(reply, range(10_000))))
    p = {(r.dimension, r.model): (r.n, r.pearson_r)
         for r in catalog.QUERIES_FOR_TESTS["pearson_by_dimension"](spark, SF001).collect()}
    assert len(p) == 21
    assert sum(n for n, _ in p.values()) == 10_000 - counts[999]


@needs_data
def test_label_distribution_golden(spark):
    d = {r.label: r for r in catalog.QUERIES_FOR_TESTS["label_distribution"](spark, SF001).collect()}
    want = Counter(t.strip() for k in range(1000) if k % 19 for t in label_string(k).split(";"))
    assert {k: r["count"] for k, r in d.items()} == want
    assert d[""].proportion == round(want[""] / sum(want.values()), 6)
    assert set(vocab.LABELS) <= set(want)


@needs_data
def test_votes_golden(spark):
    r = views.review_scores(spark, SF001)
    cols = ["check-gemini", "check-gpt", "check-claude"]
    v = r.withColumn("vote", VT.count_votes(cols, F.lit(0.8)))
    assert v.agg(F.sum("vote")).first()[0] == 611
    by = {x.vote: x["count"] for x in v.groupBy("vote").count().collect()}
    assert by[0] == 514 and by[1] == 379


@needs_data
def test_incremental_equals_batch(spark):
    inc = catalog.QUERIES_FOR_TESTS["incremental_score"](spark, SF0001)
    batch = catalog.QUERIES_FOR_TESTS["extract_score"](spark, SF0001)
    assert inc.count() == batch.count()
    assert inc.exceptAll(batch.select(*inc.columns)).count() == 0


def _duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


load_all()
ORACLE_KEYS = sorted(catalog.ORACLE_FOR_TESTS)


@needs_data
@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_oracle(spark, name):
    con = _duck(SF0001)
    df = catalog.QUERIES_FOR_TESTS[name](spark, SF0001)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(catalog.ORACLE_FOR_TESTS[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == exp


@needs_data
def test_incremental_resumes_only_new_files(spark, tmp_path):
    from qualmark.streaming import incremental as inc
    r = views.responses(spark, SF0001).select("item_id", "dimension", "model", "response")
    src, sink, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    r.filter("item_id < 500").write.parquet(src + "/a")
    assert inc.run_incremental(spark, src + "/*", sink, ckpt) >= 1
    first = inc.read_scored(spark, sink).count()
    assert inc.run_incremental(spark, src + "/*", sink, ckpt) == 0  # nothing new
    r.filter("item_id >= 500").write.parquet(src + "/b")
    assert inc.run_incremental(spark, src + "/*", sink, ckpt) >= 1
    out = inc.read_scored(spark, sink)
    assert first == 500 and out.count() == r.count()
    assert out.select("item_id").distinct().count() == r.count()
