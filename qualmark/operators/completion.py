"""Pluggable model calls: a batch function applied with ``mapInArrow``.

``fn(batch: list[list[dict]]) -> list[str]`` receives the chat messages of some
rows and returns one reply per row. A task keeps up to ``in_flight`` calls running
in threads and puts the replies back in row order; ``calls_per_second`` spaces the
calls of each model over the whole job. A failing batch is retried; if it keeps
failing, rows are retried one by one and a row that still fails gets ``''`` (later
parsed as score 999). Output depends only on the row, so a Spark task retry
recomputes the same replies; ``partitions`` bounds how many calls it repeats.

A task walks each Arrow batch in pieces, parses a call's messages when the call
starts, and hands the kept columns on as they came, so its memory is bounded by
the Arrow batch and the calls in flight, whatever the size of its partition.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_pieces, ship_package

BatchFn = Callable[[list], list]

#: Calls that a task keeps running at a time; ``fn`` is called from several threads.
IN_FLIGHT = 8
#: Pieces of a batch whose calls run ahead of the one that is being returned.
AHEAD = 2
#: Rows of a piece, in rounds of calls in flight.
ROUNDS = 4

log = logging.getLogger(__name__)


class Pace:
    """Starts of calls at least ``1 / per_second`` apart, over all threads of a task."""

    def __init__(self, per_second: float | None) -> None:
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def _call(fn: BatchFn, batch: list, max_tries: int, wait_s: float, pace: Pace) -> tuple[list[str] | None, str | None]:
    """The replies, or the reason of the last failure."""
    reason = None
    for attempt in range(max_tries):
        try:
            pace.wait()
            out = list(fn(batch))
            if len(out) != len(batch):
                raise ValueError("completion function returned a wrong number of replies")
            return ["" if x is None else str(x) for x in out], None
        except Exception as e:  # noqa: BLE001 - any model failure is retried, and reported
            reason = f"{type(e).__name__}: {str(e)[:200]}"
            log.warning("model call failed (%d of %d): %s", attempt + 1, max_tries, reason)
            if attempt + 1 < max_tries:
                time.sleep(wait_s)
    return None, reason


def _replies(fn: BatchFn, chunk: list, max_tries: int, wait_s: float, pace: Pace) -> list[tuple[str, str | None]]:
    """Reply and failure per row of a chunk: all at once, and row by row where that fails."""
    got, reason = _call(fn, chunk, max_tries, wait_s, pace)
    if got is not None:
        return [(r, None) for r in got]
    if len(chunk) == 1:
        return [("", reason)]
    out = []
    for m in chunk:
        one, reason = _call(fn, [m], max_tries, wait_s, pace)
        out.append((one[0], None) if one else ("", reason))
    return out


def complete_batch(df: DataFrame, fn: BatchFn, messages_col: str = "messages",
                   out_col: str = "response", max_tries: int = 3, wait_s: float = 0.5,
                   keep: Sequence[str] | None = None, batch_size: int = 32,
                   partitions: int | None = None, failure_col: str | None = None,
                   in_flight: int = IN_FLIGHT, calls_per_second: float | None = None) -> DataFrame:
    """Adds ``out_col`` with the model reply for each row's messages, and with
    ``failure_col`` the reason why a row has none.

    The (wide) messages column is serialised to JSON on the JVM side and not
    returned; ``keep`` picks the columns to carry (default: all others). If it names
    the messages column too, that is carried as it is, and the calls read it: a
    prompt reaches Python once either way.
    Rows are handed to ``fn`` in chunks of ``batch_size``. ``partitions`` spreads
    them over that many tasks: a retried task repeats only its own calls."""
    return _complete(df, lambda model: ("all", fn), None, messages_col, out_col, max_tries, wait_s, keep,
                     batch_size, partitions, failure_col, in_flight, calls_per_second)


def complete_routed(df: DataFrame, fns: dict, model_col: str = "model",
                    messages_col: str = "messages", out_col: str = "response",
                    max_tries: int = 3, wait_s: float = 0.5, batch_size: int = 32,
                    failure_col: str | None = None, in_flight: int = IN_FLIGHT,
                    calls_per_second: float | dict | None = None) -> DataFrame:
    """Like ``complete_batch`` but each row goes to the function registered
    for its ``model_col`` value (matched by substring of the model id, first
    registered name wins). Rows for an unknown model get ``''``.
    ``calls_per_second`` may be given by registered name."""
    def route(model):
        return next(((n, f) for n, f in fns.items() if model is not None and n in model), None)
    return _complete(df, route, model_col, messages_col, out_col, max_tries, wait_s, None, batch_size, None,
                     failure_col, in_flight, calls_per_second)


def _filled(messages: list) -> list:
    """Messages as their JSON has them: fields without a value are left out."""
    return [{k: v for k, v in m.items() if v is not None} if m is not None else None for m in messages]


def _complete(df, route, model_col, messages_col, out_col, max_tries, wait_s, keep, batch_size, partitions,
              failure_col, in_flight, calls_per_second) -> DataFrame:
    ship_package(df.sparkSession)
    whole = messages_col in (keep or ())
    keep = list(keep) if whole else [c for c in (keep or df.columns) if c != messages_col]
    src = df.select(*keep, *([] if whole else [F.to_json(F.col(messages_col)).alias("_msgs")]))
    if partitions:
        src = src.repartition(partitions)
    fields = [df.schema[c] for c in keep]  # same order as the yielded columns
    added = [out_col, *([failure_col] if failure_col else [])]
    schema = T.StructType(fields + [T.StructField(c, T.StringType(), True) for c in added])
    slots = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(partitions, slots) if partitions else slots  # that share a model's rate

    def rate_of(name: str) -> float | None:
        rate = calls_per_second.get(name) if isinstance(calls_per_second, dict) else calls_per_second
        return rate / tasks if rate else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paces: dict[str, Pace] = {}
        waiting: deque[tuple[pa.RecordBatch, list[tuple[list[int], Future]]]] = deque()

        def ask(fn: BatchFn, texts: pa.Array, at: list[int], pace: Pace) -> list[tuple[str, str | None]]:
            msgs = [texts[i].as_py() for i in at]
            if whole:
                chats = [_filled(m or []) for m in msgs]
            else:
                chats = [json.loads(m) if m is not None else [] for m in msgs]
            return _replies(fn, chats, max_tries, wait_s, pace)

        def start(pool: ThreadPoolExecutor, piece: pa.RecordBatch) -> list[tuple[list[int], Future]]:
            texts = piece.column(messages_col if whole else "_msgs")
            rows_of: dict[str, tuple[BatchFn, list[int]]] = {}
            for i, model in enumerate(piece.column(model_col).to_pylist() if model_col else [None] * piece.num_rows):
                found = route(model)
                if found is not None:
                    rows_of.setdefault(found[0], (found[1], []))[1].append(i)
            out = []
            for name, (fn, at) in rows_of.items():
                pace = paces.setdefault(name, Pace(rate_of(name)))
                for k in range(0, len(at), batch_size):
                    out.append((at[k:k + batch_size], pool.submit(ask, fn, texts, at[k:k + batch_size], pace)))
            return out

        def finish(piece: pa.RecordBatch, calls: list[tuple[list[int], Future]]) -> pa.RecordBatch:
            replies: list[tuple[str, str | None]] = [("", "no model for this row")] * piece.num_rows
            for at, call in calls:
                for i, r in zip(at, call.result()):
                    replies[i] = r
            new = [pa.array([r[k] for r in replies], pa.string()) for k in range(len(added))]
            return pa.RecordBatch.from_arrays([*piece.columns[:len(keep)], *new], names=[*keep, *added])

        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for batch in batches:
                for piece in arrow_pieces(batch, ROUNDS * in_flight * batch_size):
                    waiting.append((piece, start(pool, piece)))
                    if len(waiting) > AHEAD:
                        yield finish(*waiting.popleft())
            while waiting:
                yield finish(*waiting.popleft())

    return src.mapInArrow(run, schema)
