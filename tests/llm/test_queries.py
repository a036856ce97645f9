"""The registered queries on a given table, against SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__
from qualmark.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [
        f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings", "conversations"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    if name in queries.ORACLE:
        want = db.sql(queries.ORACLE[name]).select(*df.columns).fetchall()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    else:
        rows = {"op12_vector_codes": "count(*) from embeddings",
                "op13_conversation_repair": "count(distinct conv_id) from conversations"}
        assert len(got) == db.sql(f"select {rows.get(name, 'count(*) from documents')}").fetchall()[0][0]
