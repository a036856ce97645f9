"""Driver contract and fixture sizes (FIXTURES §2 row counts)."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001, SF0001
from qualmark.plans import catalog
from qualmark.sources import views

needs_data = pytest.mark.skipif(not os.path.isdir(SF001), reason="test data missing")


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 85
    for sql in o.values():
        assert sql.strip()


@needs_data
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["dimension", "model", "n", "pearson_r"]
    assert df.count() == 21


@needs_data
@pytest.mark.parametrize("sf,expect", [(SF0001, (34, 1000, 200, 500, 87, 20)),
                                       (SF001, (233, 10000, 1000, 500, 399, 100))])
def test_fixture_sizes(spark, sf, expect):
    got = (views.qa_items(spark, sf).count(),
           views.responses(spark, sf).count(),
           views.review_scores(spark, sf).count(),
           views.logits(spark, sf).count(),
           views.binary_labels(spark, sf).count(),
           views.chats(spark, sf).select("conv_id").distinct().count())
    assert got == expect


@needs_data
def test_label_view_sizes(spark):
    assert views.labeled_docs(spark, SF001).count() == 1000
    assert views.labeled_docs(spark, SF001).filter(F.col("error_label").isNull()).count() == 53


@needs_data
def test_every_query_plans(spark):
    """Every registered query builds an analysed DataFrame (model stages are
    left out: they train when built)."""
    heavy = {"train_identifier", "identify_errors", "train_verifier", "verify_labels",
             "select_model", "select_identifier", "self_train_round", "build_training_set",
             "evaluate_with_identifier"}
    for name, fn in E.queries().items():
        if name in heavy:
            continue
        df = fn(spark, SF0001)
        assert len(df.schema.fields) > 0, name


def test_registry_loads_without_a_session(tmp_path):
    """The driver may list queries and SQL before it starts Spark."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(E.__file__))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[0]) >= 100
