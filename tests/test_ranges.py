"""Large JSON arrays and CSV files over many byte ranges, against Spark's own readers."""

import csv
import json
import random

import pytest

from qualmark.sources import ranges, tables

CSV_SCHEMA = "id long, text string, note string"
JSON_SCHEMA = "id long, text string, tags array<string>, sub struct<a: string, b: array<struct<c: int>>>"


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of 197 bytes: records cross borders, some lie over several."""
    conf = {"spark.sql.files.maxPartitionBytes": "197", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(n, seed=1):
    rng = random.Random(seed)
    odd = ['a "quoted" word', "line one\nline two", "}{][", '}, {"id": 1', "back\\slash \\", '\\" both', "", "é ü 漢字 \u2028x",
           "comma, and ;", "\\\\", "long " * 60, '"', '""', "ends in quote\"", "[1, {2}]", "tab\there"]
    return [" ".join(rng.choice(odd) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def rows_of(df):
    return sorted(map(str, df.collect()))


def write_csv(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "text", "note"])
        w.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_sparks_reader(spark, small_ranges, tmp_path, end):
    for k in range(3):
        got = texts(30, k)
        write_csv(tmp_path / f"f{k}.csv", [(i, t, None if i % 5 else "n,o\nte") for i, t in enumerate(got)], end)
    (tmp_path / "g.csv").write_text("id,text,note\n\n7,x,\n\n8,\"y\nz\",last")  # blank lines, no line end
    (tmp_path / "h.csv").write_text("id,text,note\n")
    path = str(tmp_path)

    def theirs(schema=None):
        reader = spark.read.options(header="true", escape='"', multiLine="true")
        return rows_of((reader.schema(schema) if schema else reader).csv(path))

    own = ranges.read_csv(spark, path, spark.createDataFrame([], CSV_SCHEMA).schema)
    assert rows_of(own) == theirs(CSV_SCHEMA)
    assert rows_of(ranges.read_csv(spark, path)) == theirs()
    assert ranges.records(spark, path, ranges.Csv).rdd.getNumPartitions() > 20
    assert rows_of(tables.read_table(spark, path, fmt="csv")) == theirs()


def values(n, seed=2):
    rng = random.Random(seed)
    for i, t in enumerate(texts(n, seed)):
        yield {"id": i, "text": t, "tags": texts(rng.randrange(3), i),
               "sub": rng.choice([None, {"a": t[::-1], "b": [{"c": 1}, {"c": i}]}, {"a": "}]", "b": []}])}


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (None, False), (2, True)])
def test_json_equals_sparks_reader(spark, small_ranges, tmp_path, indent, ascii_only):
    for k in range(2):
        (tmp_path / f"f{k}.json").write_text(json.dumps(list(values(25, k)), indent=indent, ensure_ascii=ascii_only),
                                             encoding="utf-8")
    (tmp_path / "empty.json").write_text(" [ ]\n")
    path = str(tmp_path)
    own = ranges.read_json(spark, path, spark.createDataFrame([], JSON_SCHEMA).schema)
    assert own.rdd.getNumPartitions() > 20
    assert rows_of(own) == rows_of(spark.read.schema(JSON_SCHEMA).json(path, multiLine=True))
    assert rows_of(ranges.read_json(spark, path).select("id", "text", "sub.a")) == rows_of(
        spark.read.json(path, multiLine=True).select("id", "text", "sub.a"))
    assert rows_of(tables.scan_json(spark, path, own.schema, json_array=True)) == rows_of(own)


def test_arrays_and_lines_in_one_folder(spark, small_ranges, tmp_path):
    rows = list(values(30, 5))
    (tmp_path / "a.json").write_text(json.dumps(rows[:15]))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in rows[15:]))
    got = ranges.read_json(spark, str(tmp_path), spark.createDataFrame([], JSON_SCHEMA).schema)
    assert sorted(r.id for r in got.collect()) == list(range(30))


def test_record_over_many_ranges(spark, small_ranges, tmp_path):
    """Records longer than several ranges, and a header that is."""
    rows = [{"id": i, "text": "x{" * 400 * (i % 2)} for i in range(6)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = ranges.read_json(spark, str(tmp_path / "a.json"), spark.createDataFrame([], "id long, text string").schema)
    assert sorted((r.id, r.text) for r in got.collect()) == [(r["id"], r["text"]) for r in rows]
    wide = "n" * 300
    write = tmp_path / "b.csv"
    write.write_text(f'id,"{wide}\n{wide}",note\n1,"{"q" * 500}\n",z\n2,b,c\n')
    got = ranges.read_csv(spark, str(write), spark.createDataFrame([], CSV_SCHEMA).schema)
    assert sorted(map(tuple, got.collect())) == [(1, "q" * 500 + "\n", "z"), (2, "b", "c")]


def test_no_files_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.csv").write_text("")
    schema = spark.createDataFrame([], CSV_SCHEMA).schema
    assert ranges.read_json(spark, str(tmp_path / "a.json"), schema).collect() == []
    assert ranges.read_csv(spark, str(tmp_path / "b.csv"), schema).collect() == []
