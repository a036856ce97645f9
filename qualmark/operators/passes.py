"""Linear text models trained in passes, the best pass kept.

A model has one logistic head per label over hashed words, all heads in one
matrix: a pass reads the training rows once for all of them. Rows are dealt by
key into shards; a task walks a shard in key order with small steps from the
current weights, and returns how far each feature moved and how many of its rows
hold it. The mean of these moves (by feature, over the shards that hold it) is
the next state. After each pass the dev rows are scored by a distributed metric;
training stops after ``patience`` passes without gain, and the best state is
returned with the history of all passes.

What comes to the driver is bounded by the feature space (2**18 by default).
Results do not depend on the partitioning but for the order of float sums.

``LinearModel`` also scores single texts without a job (``score_text``), and is
saved and loaded as a table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import md5_u32
from ..session import arrow_pieces, discard, materialize, ship_package

NUM_FEATURES = 1 << 18
MAX_PASSES = 30
PATIENCE = 3
#: Passes of a training without dev rows.
PASSES = 10
SHARD_ROWS = 1024
STEP_ROWS = 16
#: Features of a shard's result that a task hands on at a time.
MOVED_ROWS = 1 << 14
RATE = 4.0
DECAY = 0.1

#: Words are runs of letters and digits, A-Z lower-cased, and of all that is not ASCII.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_ids(text: str | None, num_features: int = NUM_FEATURES) -> list[int]:
    """The hashed words of a text, repeats included; None has none."""
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) % num_features
            for w in _WORD.findall((text or "").translate(_LOWER))]


@dataclass
class LinearModel:
    """``at``: the features that have a weight, rising; ``weights``: (features, heads).
    A text's features weigh 1 + ln(count), scaled to length one."""

    heads: int
    num_features: int = NUM_FEATURES
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.weights is None:
            self.weights = np.zeros((len(self.at), self.heads))
        if self.bias is None:
            self.bias = np.zeros(self.heads)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.num_features, self.heads))
        out[self.at] = self.weights
        return out

    def logits(self, df: DataFrame, text_col: str = "text", out_col: str = "logits") -> DataFrame:
        """``df`` with the logits of its texts; texts reach Python as word numbers."""
        ship_package(df.sparkSession)
        kind = T.StructType([f for f in df.schema.fields if f.name != out_col]
                            + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
        keep, model = kind.names[:-1], self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = model.dense()
            for batch in batches:
                for piece in arrow_pieces(batch):
                    got = Rows.of_texts(piece.column(text_col), model.num_features).margins(weights) + model.bias
                    yield pa.RecordBatch.from_arrays([*map(piece.column, keep), _lists(got)], names=[*keep, out_col])

        return df.mapInArrow(run, kind)

    def _score(self, rows: DataFrame) -> DataFrame:
        """(y, logits) of rows of ``_features``."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = model.dense()
            for batch in batches:
                for piece in arrow_pieces(batch):
                    got = Rows.of_lists(piece.column(1), piece.column(2)).margins(weights) + model.bias
                    yield pa.RecordBatch.from_arrays([piece.column(0), _lists(got)], names=["y", "logits"])

        return rows.select("y", "feature", "value").mapInArrow(run, "y array<int>, logits array<double>")

    def score_text(self, text: str | None) -> list[float]:
        """The logits of one text, without a job."""
        counts: dict[int, int] = {}
        for i in word_ids(text, self.num_features):
            counts[i] = counts.get(i, 0) + 1
        if not hasattr(self, "_place"):
            self._place = {int(f): k for k, f in enumerate(self.at)}
        out, norm = np.zeros(self.heads), 0.0
        for i, c in counts.items():
            value = 1 + math.log(c)
            norm += value * value
            if i in self._place:
                out += value * self.weights[self._place[i]]
        return list(out / math.sqrt(norm) + self.bias if norm else self.bias.copy())

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per feature; row -1 holds the size and the biases."""
        feature = np.append(-1, self.at)
        weights = np.vstack([self.bias, self.weights])
        table = pa.table({"feature": feature, "size": np.full(len(feature), self.num_features),
                          "weights": pa.array(list(weights), pa.list_(pa.float64()))})
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    table = spark.read.parquet(path).orderBy("feature").toArrow()
    weights = np.array(table["weights"].to_pylist())
    return LinearModel(weights.shape[1], table["size"][0].as_py(), table["feature"].to_numpy()[1:], weights[1:], weights[0])


class Rows:
    """Texts as rows of (feature, value), features of a row all different."""

    def __init__(self, feature: np.ndarray, value: np.ndarray, start: np.ndarray) -> None:
        self.feature, self.value, self.start, self.n = feature, value, start, len(start) - 1

    @classmethod
    def of_texts(cls, texts: pa.Array, num_features: int) -> Rows:
        feature, value, start = [], [], [0]
        for text in texts:
            got, count = np.unique(np.array(word_ids(text.as_py(), num_features), np.int64), return_counts=True)
            x = 1 + np.log(count)
            feature.append(got)
            value.append(x / np.sqrt((x * x).sum()) if len(x) else x)
            start.append(start[-1] + len(got))
        return cls(np.concatenate([np.zeros(0, np.int64), *feature]), np.concatenate([np.zeros(0), *value]),
                   np.array(start))

    @classmethod
    def of_lists(cls, features: pa.Array, values: pa.Array) -> Rows:
        lens = features.value_lengths().to_numpy(zero_copy_only=False)
        return cls(features.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False),
                   np.concatenate([[0], np.cumsum(lens)]))

    def lists(self) -> tuple[pa.Array, pa.Array]:
        start = pa.array(self.start.astype(np.int32))
        return (pa.ListArray.from_arrays(start, pa.array(self.feature.astype(np.int32))),
                pa.ListArray.from_arrays(start, pa.array(self.value)))

    def margins(self, weights: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n if hi is None else hi
        out = np.zeros((hi - lo, weights.shape[1]))
        for i in range(lo, hi):
            a, b = self.start[i], self.start[i + 1]
            out[i - lo] = self.value[a:b] @ weights[self.feature[a:b]]
        return out

    def step(self, weights: np.ndarray, lo: int, hi: int, move: np.ndarray) -> None:
        for i in range(lo, hi):
            a, b = self.start[i], self.start[i + 1]
            weights[self.feature[a:b]] += np.outer(self.value[a:b], move[i - lo])


def _lists(table: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32),
                                    pa.array(table.reshape(-1)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _features(df: DataFrame, text_col: str, target: Column, key: str, num_features: int) -> DataFrame:
    """(key, y, feature, value) of the rows that have a target."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("key"), target.cast("array<int>").alias("y"),
                     F.col(text_col).cast("string").alias("text")).filter(F.col("y").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrow_pieces(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], *Rows.of_texts(piece.column(2), num_features).lists()],
                                                 names=["key", "y", "feature", "value"])

    return rows.mapInArrow(run, "key string, y array<int>, feature array<int>, value array<double>")


def one_pass(rows: DataFrame, model: LinearModel, rate: float, reg: float) -> LinearModel:
    """The state after one pass over ``rows`` (shard, feature, value, y), shard by shard."""
    ship_package(rows.sparkSession)
    heads = model.heads
    kind = "feature int, n long, " + ", ".join(f"d{h} double" for h in range(heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = model.dense()
        shard, state = None, None

        def result() -> Iterator[pa.RecordBatch]:
            """The moved features in order, the biases as -1 behind them; ``weights``
            are the state's again."""
            weights, bias, touched, n = state
            moved = np.nonzero(touched)[0]
            for lo in range(0, len(moved), MOVED_ROWS):
                f = moved[lo:lo + MOVED_ROWS]
                yield record(f, touched[f], (weights[f] - base[f]) * touched[f][:, None])
                weights[f], touched[f] = base[f], 0
            yield record(np.array([-1]), np.array([n]), ((bias - model.bias) * n)[None, :])

        def record(feature: np.ndarray, n: np.ndarray, delta: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(feature.astype(np.int32)), pa.array(n.astype(np.int64)), *map(pa.array, np.ascontiguousarray(delta.T))],
                names=["feature", "n", *[f"d{h}" for h in range(heads)]])

        for batch in batches:
            x = Rows.of_lists(batch.column(1), batch.column(2))
            y = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(x.n, heads).astype(float)
            cut = np.flatnonzero(np.diff(batch.column(0).to_numpy(zero_copy_only=False))) + 1
            for lo, hi in zip([0, *cut], [*cut, x.n]):
                now = batch.column(0)[int(lo)].as_py()
                if now != shard:
                    if state is not None:
                        yield from result()
                    weights, touched = (base.copy(), np.zeros(len(base))) if state is None else (state[0], state[2])
                    shard, state = now, [weights, model.bias.copy(), touched, 0]
                weights, bias, touched, _ = state
                state[3] += hi - lo
                touched += np.bincount(x.feature[x.start[lo]:x.start[hi]], minlength=len(base))
                for a in range(lo, hi, STEP_ROWS):
                    b = min(a + STEP_ROWS, hi)
                    off = y[a:b] - _sigmoid(x.margins(weights, a, b) + bias)
                    if reg:
                        weights[np.unique(x.feature[x.start[a]:x.start[b]])] *= 1 - min(reg * rate, 1.0) / STEP_ROWS
                    x.step(weights, a, b, rate * off)
                    bias += rate / STEP_ROWS * off.sum(0)
        if state is not None:
            yield from result()

    moved = rows.select("shard", "feature", "value", "y").mapInArrow(run, kind).groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.sum(f"d{h}").alias(f"d{h}") for h in range(heads)]).toArrow()
    feature = moved["feature"].to_numpy()
    delta = np.stack([moved[f"d{h}"].to_numpy() for h in range(heads)], 1) / moved["n"].to_numpy()[:, None]
    weights, bias = model.weights.copy(), model.bias.copy()
    real = feature >= 0
    weights[np.searchsorted(model.at, feature[real])] += delta[real]
    if (~real).any():
        bias += delta[~real][0]
    return LinearModel(heads, model.num_features, model.at, weights, bias)


def fit(train: DataFrame, target: Column, heads: int, dev: DataFrame | None = None,
        score: Callable[[DataFrame], float] | None = None, text_col: str = "text", key: str = "item_id",
        max_passes: int | None = None, patience: int = PATIENCE, rate: float = RATE, reg: float = 0.0,
        num_features: int = NUM_FEATURES, shard_rows: int = SHARD_ROWS, seed: int = 0
        ) -> tuple[LinearModel, list[tuple[int, float]]]:
    """The best pass's model and [(pass, dev score)], one entry per pass run.

    ``target``: ``heads`` zeros and ones. ``score``: dev rows with ``y`` and
    ``logits`` -> a number, greater is better; the first of equal passes is kept.
    Without dev rows all ``max_passes`` are run and the last is returned. Rows
    with a NULL target are left out; without rows the model answers 0 everywhere."""
    x = materialize(_features(train, text_col, target, key, num_features), "train-words")
    n = x.count()
    used = x.select(F.explode("feature").alias("feature")).distinct().orderBy("feature").toArrow()
    model = LinearModel(heads, num_features, used["feature"].to_numpy().astype(np.int64))
    if not n:
        discard(x)
        return model, []
    shards = -(-n // shard_rows)
    dealt = materialize(x.withColumn("shard", (md5_u32(seed, F.col("key")) % shards).cast("int")).repartition("shard"),
                        "train-shards")
    held = None
    if dev is not None:
        held = materialize(_features(dev, text_col, target, key, num_features), "dev-words")
    best, history = model, []
    try:
        for i in range(1, (max_passes or (PASSES if held is None else MAX_PASSES)) + 1):
            # sorted again on each read: a file may be split or packed with others
            rows = dealt.repartition("shard").sortWithinPartitions("shard", "key") if shards > 1 else \
                dealt.coalesce(1).sortWithinPartitions("key")
            model = one_pass(rows, model, rate / (1 + DECAY * (i - 1)), reg)
            if held is None:
                best = model
                continue
            history.append((i, score(model._score(held))))
            top = max(s for _, s in history)
            kept = next(p for p, s in history if s == top)
            if kept == i:
                best = model
            if i - kept >= patience:
                break
    finally:
        for t in (x, dealt, *([held] if held is not None else [])):
            discard(t)
    return best, history
