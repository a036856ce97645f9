"""The model call inside the stream: requests land as files, replies in a sink.

Each micro-batch is a *step*. A step takes the batch's new requests and the queue
of requests that failed before, leaves out keys that already have a reply, calls
the model, and writes

    calls/step=k     what the calls gave, written as soon as they are made
    replies/step=k   one row per answered (or given up) key
    queue/step=k     every request still without a reply, with its tries
    log/step=k       the step's name, written last: this commits it

Only logged steps count. A batch that is run again after its step was logged is
skipped; one cut off between call and commit finds its calls and only writes the
rest. So each key has exactly one reply, however often a batch is retried. One
stream writes a sink at a time.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import completion
from ..operators.rows import RESPONSE_KEYS, with_score
from ..session import path_exists, small_batches

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
REQUEST_SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("dimension", T.StringType()),
                               T.StructField("model", T.StringType()), T.StructField("messages", MESSAGES)])
#: Steps that ask for a request before its failure is written as its reply.
MAX_TRIES = 3


class ScoringSink:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = RESPONSE_KEYS) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)

    def _at(self, kind: str, step: int) -> str:
        return f"{self.path}/{kind}/step={step}"

    def _written(self, kind: str, step: int) -> bool:
        return path_exists(self.spark, os.path.join(self._at(kind, step), "_SUCCESS"))

    def steps(self) -> list[str]:
        """Names of the committed steps, in order."""
        names: list[str] = []
        while self._written("log", len(names) + 1):
            names.append(self.spark.read.parquet(self._at("log", len(names) + 1)).first()["name"])
        return names

    def replies(self) -> DataFrame:
        """Keys, response, failure and score of every key that has a reply."""
        n = len(self.steps())
        schema = T.StructType([f for f in REQUEST_SCHEMA if f.name in self.keys]).add("response", "string").add(
            "failure", "string").add("score", "integer")
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._at("replies", k + 1) for k in range(n)])

    def queue(self) -> DataFrame:
        """Requests still without a reply: keys, messages, tries."""
        n = len(self.steps())
        schema = T.StructType([*REQUEST_SCHEMA.fields]).add("tries", "integer")
        return self.spark.read.schema(schema).parquet(self._at("queue", n)) if n else \
            self.spark.createDataFrame([], schema)

    def step(self, name: str, requests: DataFrame, fn: completion.BatchFn, max_tries: int = MAX_TRIES, **calls) -> bool:
        """Run one step and commit it; False if a step of this name already is."""
        done = self.steps()
        if name in done:
            return False
        k = len(done) + 1
        if not self._written("calls", k):
            self._call(k, requests, fn, **calls)
        got = self.spark.read.parquet(self._at("calls", k))
        over = (F.col("response") != "") | (F.col("tries") >= max_tries)
        replies = with_score(got.filter(over).select(*self.keys, "response", "failure"))
        replies.write.mode("overwrite").parquet(self._at("replies", k))
        got.filter(~over).select(*self.keys, "messages", "tries").write.mode("overwrite").parquet(self._at("queue", k))
        self._commit(k, name)
        return True

    def _call(self, k: int, requests: DataFrame, fn: completion.BatchFn, **calls) -> None:
        new = requests.select(*self.keys, "messages").dropDuplicates(self.keys).withColumn("tries", F.lit(0))
        waiting = self.queue()
        new = new.join(waiting.select(*self.keys), self.keys, "left_anti")
        todo = waiting.unionByName(new).join(self.replies().select(*self.keys), self.keys, "left_anti")
        # the messages are carried along, as the queue keeps them
        got = completion.complete_batch(todo, fn, keep=todo.columns, failure_col="failure", **calls)
        failure = F.when(F.col("response") == "", F.coalesce("failure", F.lit("empty reply")))
        got = got.withColumn("failure", failure).withColumn("tries", F.col("tries") + 1)
        with small_batches(self.spark):  # a row is a whole prompt
            got.write.mode("overwrite").parquet(self._at("calls", k))

    def _commit(self, k: int, name: str) -> None:
        self.spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(self._at("log", k))


def run_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, fn: completion.BatchFn,
                max_files_per_trigger: int | None = None, max_tries: int = MAX_TRIES, **calls) -> int:
    """Score all requests that landed in ``source_dir`` since the last run and
    stop. Returns the number of steps run; what failed waits in the queue."""
    sink, ran = ScoringSink(spark, sink_dir), []
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def step(df: DataFrame, batch_id: int) -> None:
        stream = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        # the batch's own session has its own settings; the sink keeps to the caller's
        ran.append(sink.step(f"{stream}/{batch_id}", df, fn, max_tries, **calls))

    q = (reader.parquet(source_dir).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(ran)


def retry_failed(spark: SparkSession, sink_dir: str, fn: completion.BatchFn, max_tries: int = MAX_TRIES, **calls) -> int:
    """Steps over the queue alone, until it is empty or everything is given up."""
    sink, ran = ScoringSink(spark, sink_dir), 0
    while not sink.queue().isEmpty():
        nothing = spark.createDataFrame([], REQUEST_SCHEMA)
        ran += sink.step(f"retry/{len(sink.steps()) + 1}", nothing, fn, max_tries, **calls)
    return ran
