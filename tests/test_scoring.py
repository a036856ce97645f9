"""Calls in flight, paced and resumed; the model call inside the stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from qualmark.functions import text as tx
from qualmark.operators import completion as C
from qualmark.plans import jobs
from qualmark.streaming import scoring


def requests(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "item_id long").coalesce(1)
    return df.select("item_id", F.lit("fluency").alias("dimension"), F.lit("m").alias("model"),
                     tx.build_messages("sys", F.concat(F.lit("p"), F.col("item_id").cast("string"))).alias("messages"))


def numbers():
    """The number in a prompt; made anew, as workers cannot import this module."""
    return lambda m: int(m[-1]["content"][1:])


def counted(folder, fail=lambda i: False, sleep=0.0):
    """A model that notes every row it is asked for."""
    folder, number = str(folder), numbers()

    def fn(batch):
        for m in batch:
            with open(os.path.join(folder, f"{number(m)}-{time.time_ns()}"), "w"):
                pass
        time.sleep(sleep)
        if any(fail(number(m)) for m in batch):
            raise RuntimeError("no")
        return [f"score: {number(m) % 3 + 1}" for m in batch]
    return fn


def asked(folder):
    out = {}
    for f in os.listdir(folder):
        out[int(f.split("-")[0])] = out.get(int(f.split("-")[0]), 0) + 1
    return out


def test_calls_overlap_and_order_is_kept(spark):
    number = numbers()

    def slow(batch):
        time.sleep(0.3 if number(batch[0]) % 7 == 0 else 0.1)
        return [f"r{number(m)}" for m in batch]

    df = requests(spark, range(40))
    C.complete_batch(df.limit(1), slow).collect()  # workers are up
    took = {}
    for n in (1, 16):
        t = time.time()
        rows = C.complete_batch(df, slow, batch_size=1, in_flight=n).collect()
        took[n] = time.time() - t
        assert [(r.item_id, r.response) for r in rows] == [(i, f"r{i}") for i in range(40)]
    assert took[16] < took[1] / 3


def test_pace(spark):
    """20 calls at 20 a second over the job, on one task of a session with many slots."""
    slots = spark.sparkContext.defaultParallelism
    pace = C.Pace(50)
    t = time.time()
    for _ in range(11):
        pace.wait()
    assert 0.19 < time.time() - t < 1
    t = time.time()
    C.complete_batch(requests(spark, range(11)), lambda b: ["x"] * len(b), batch_size=1,
                     calls_per_second=50 * slots).collect()
    assert time.time() - t >= 0.19


def test_killed_run_repeats_one_wave_at_most(spark, tmp_path):
    sink, notes = str(tmp_path / "sink"), tmp_path / "notes"
    notes.mkdir()
    req, folder, model = requests(spark, range(60)), str(notes), counted(notes)

    def dies(batch):  # the worker's whole task fails, with it the run
        if len(os.listdir(folder)) >= 30:
            raise KeyboardInterrupt
        return model(batch)

    with pytest.raises(Exception):
        jobs.resume_scoring(req, sink, dies, waves=6, batch_size=2)
    saved = spark.read.parquet(sink).count()
    assert 0 < saved < 60
    out = jobs.resume_scoring(req, sink, counted(notes), waves=6, batch_size=2)
    assert out.count() == 60 and {r.score for r in out.collect()} == {1, 2, 3}
    again = sum(n - 1 for n in asked(notes).values())
    assert again <= 30 - saved + 2 * C.IN_FLIGHT and len(asked(notes)) == 60


def test_calls_run_a_bounded_piece_ahead(spark, monkeypatch):
    """However large the Arrow batch, a task asks for a few rounds of calls ahead and
    returns pieces as small; rows and their order are kept, columns as they came."""
    import json
    import pyarrow as pa
    df, asked_for = requests(spark, range(2)).drop("model"), []

    def fn(batch):
        asked_for.extend(int(m[-1]["content"][1:]) for m in batch)
        return [m[-1]["content"].upper() for m in batch]

    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = C.complete_batch(df, fn, batch_size=2, in_flight=2)
    n, most = 10_000, C.ROUNDS * 2 * 2
    messages = [json.dumps([{"role": "user", "content": f"p{i}"}]) for i in range(n)]
    got = run(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["fluency", None] * (n // 2)), pa.array(messages)],
                                               names=["item_id", "dimension", "_msgs"])]))
    first = next(got)
    assert first.num_rows <= most and len(asked_for) <= (C.AHEAD + 1) * most
    pieces = [first, *got]
    assert pa.Table.from_batches(pieces).to_pydict() == {
        "item_id": list(range(n)), "dimension": ["fluency", None] * (n // 2), "response": [f"P{i}" for i in range(n)]}
    assert max(p.num_rows for p in pieces) <= most


def test_kept_messages_reach_python_once(spark, tmp_path, monkeypatch):
    """Where messages are kept, as in the stream's steps, calls read the kept column;
    they see the same messages as from JSON, and kept ones come back as they were."""
    import json
    kind = spark.createDataFrame([], scoring.REQUEST_SCHEMA).schema
    chats = [[("system", "s"), ("user", "é\n\"x")], [("user", None)], [(None, "p")], [], None, [None, ("user", "")]]
    df = spark.createDataFrame([(i, "fluency", "m", c) for i, c in enumerate(chats)], kind).coalesce(1)
    went, real = [], type(df).mapInArrow

    def noted(self, *args, **kw):
        went.append([f.name for f in self.schema.fields if f.name not in ("item_id", "dimension", "model", "tries")])
        return real(self, *args, **kw)

    monkeypatch.setattr(type(df), "mapInArrow", noted)

    def echo(batch):
        return [json.dumps(m, sort_keys=True) for m in batch]

    plain = C.complete_batch(df, echo).orderBy("item_id").collect()
    kept = C.complete_batch(df, echo, keep=df.columns).orderBy("item_id").collect()
    assert [r.response for r in kept] == [r.response for r in plain]
    assert [r.messages and [m and tuple(m) for m in r.messages] for r in kept] == chats
    scoring.ScoringSink(spark, str(tmp_path / "sink")).step("a", df.limit(1), echo)
    assert went == [["_msgs"], ["messages"], ["messages"]]


def test_steps_send_small_batches(spark, tmp_path, monkeypatch):
    """Prompts reached a step's workers 10,000 at a time; the caller's settings come back, also after a failure."""
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before, sizes, real = [spark.conf.get(n) for n in names], tmp_path / "sizes", type(spark.range(1)).mapInArrow
    folder = str(sizes)
    sizes.mkdir()

    def noted(self, run, schema):
        def counting(batches):
            def seen():
                for b in batches:
                    open(os.path.join(folder, f"{b.num_rows}-{time.time_ns()}"), "w").close()
                    yield b
            yield from run(seen())
        return real(self, counting, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", noted)
    number = numbers()
    # one partition on the way to the workers, whatever the session's settings
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        land(requests(spark, range(2500)), tmp_path / "in", 1)
        args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
        scoring.run_scoring(*args, lambda batch: [f"score: {number(m) % 3 + 1}" for m in batch])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [int(f.split("-")[0]) for f in os.listdir(folder)]
    assert sum(rows) == 2500 and max(rows) <= 1024
    assert [spark.conf.get(n) for n in names] == before
    got = scoring.ScoringSink(spark, str(tmp_path / "out")).replies().collect()
    assert {r.item_id: r.score for r in got} == {i: i % 3 + 1 for i in range(2500)}

    def dies(batch):
        raise KeyboardInterrupt

    with pytest.raises(Exception):
        scoring.ScoringSink(spark, str(tmp_path / "sink")).step("a", requests(spark, range(2)), dies)
    assert [spark.conf.get(n) for n in names] == before


def land(df, folder, n):
    for k in range(n):
        df.filter(F.col("item_id") % n == k).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_killed_between_call_and_commit(spark, tmp_path, monkeypatch):
    source, sink, check, notes = (tmp_path / n for n in ("in", "out", "check", "notes"))
    notes.mkdir()
    land(requests(spark, range(30)), source, 3)
    fn = counted(notes, fail=lambda i: i % 10 == 4)
    args = (spark, str(source), str(sink), str(check))
    commit = scoring.ScoringSink._commit

    def dies(self, k, name):
        if k == 2:
            raise RuntimeError("killed")
        commit(self, k, name)

    monkeypatch.setattr(scoring.ScoringSink, "_commit", dies)
    with pytest.raises(Exception, match="killed"):
        scoring.run_scoring(*args, fn, max_files_per_trigger=1, max_tries=5, wait_s=0.0, batch_size=1)
    monkeypatch.setattr(scoring.ScoringSink, "_commit", commit)
    table = scoring.ScoringSink(spark, str(sink))
    assert len(table.steps()) == 1 and table.replies().count() < 15
    first = asked(notes)
    scoring.run_scoring(*args, fn, max_files_per_trigger=1, max_tries=5, wait_s=0.0, batch_size=1)
    assert len(table.steps()) == 3
    ids = [r.item_id for r in table.replies().collect()]
    assert sorted(ids) == [i for i in range(30) if i % 10 != 4]
    assert {r.item_id for r in table.queue().collect()} == {4, 14, 24}
    # what was called before the kill was not called again
    assert all(asked(notes)[i] == n for i, n in first.items() if i % 10 != 4)
    # the same requests once more, and a failed one: nothing doubles
    land(requests(spark, [1, 4, 4, 33]), source, 1)
    scoring.run_scoring(*args, counted(notes), max_tries=5)
    assert sorted(r.item_id for r in table.replies().collect()) == sorted([*range(30), 33])
    assert table.queue().isEmpty()


def test_given_up_after_max_tries(spark, tmp_path):
    source, sink, notes = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "notes"
    notes.mkdir()
    land(requests(spark, range(4)), source, 1)
    fn = counted(notes, fail=lambda i: i == 2)
    scoring.run_scoring(spark, source, sink, str(tmp_path / "check"), fn, max_tries=3, wait_s=0.0)
    assert scoring.retry_failed(spark, sink, fn, max_tries=3, wait_s=0.0) == 2
    got = {r.item_id: (r.score, r.failure) for r in scoring.ScoringSink(spark, sink).replies().collect()}
    assert got[2] == (999, "RuntimeError: no") and got[1] == (2, None) and len(got) == 4
