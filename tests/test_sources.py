"""Readers and writers: JSON arrays, CSV, dispatch by extension."""

import json
import os

import pytest
from pyspark.sql import types as T

from qualmark.sources import tables


def test_json_array_file(spark, tmp_path):
    recs = [{"item_id": 1, "passage": "p é", "question": "q?", "answer": "a", "source": "s_1"},
            {"item_id": 2, "passage": "p2", "question": None, "answer": "b", "source": "s_2"}]
    path = tmp_path / "data.json"
    path.write_text(json.dumps(recs, ensure_ascii=False), encoding="utf-8")
    df = tables.scan_json(spark, str(path), tables.QA_SCHEMA, json_array=True)
    rows = sorted(df.collect(), key=lambda r: r.item_id)
    assert [r.passage for r in rows] == ["p é", "p2"] and rows[1].question is None


def test_csv_and_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline', "q", "x", "s")], tables.QA_SCHEMA)
    out = str(tmp_path / "t.csv")
    df.write.option("header", "true").option("escape", '"').csv(out)
    back = tables.read_table(spark, out, tables.QA_SCHEMA).collect()
    assert back[0].passage == 'a "quoted"\nline'
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.xlsx"))


def test_json_round_trip_keeps_non_ascii(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ètion ü", "¿q?", "a", "s")], tables.QA_SCHEMA)
    out = str(tmp_path / "j")
    tables.sink_json(df, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read()
                   for f in os.listdir(out) if f.endswith(".json"))
    assert "Ètion ü" in text
    assert tables.scan_json(spark, out, tables.QA_SCHEMA).first().passage == "Ètion ü"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_sink_prunes_partitions(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, ["fluency", "clarity"][i % 2], i % 3) for i in range(20)],
                               "item_id long, dimension string, score int")
    out = str(tmp_path / "scored")
    tables.sink_table(df, out, partition_by=["dimension"])
    back = spark.read.parquet(out).filter(F.col("dimension") == "fluency").select("item_id", "score")
    plan = _plan(back)
    assert "PartitionFilters: [isnotnull(dimension" in plan and "fluency" in plan
    assert back.count() == 10


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F
    d = tables.scan_table(spark, "/root/testdata/sf0.001/documents.parquet")
    q = d.filter(F.col("doc_id") > 10).select("doc_id", "source")
    plan = _plan(q)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,10)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
