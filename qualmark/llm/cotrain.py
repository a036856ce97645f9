"""Quality classifier by co-training two views.

The text view sees the words of the whole text and binned style measures; the
metadata view sees source, language and size. Both start from the labelled
documents. In each round either view labels the documents of an unlabelled pool
that it is most sure of, for the other view to learn from. At the end both are
calibrated on held-out labels, their odds are combined, and every document is
scored. A document is rejected if the combined probability of being bad (low
quality or toxic) reaches the cutoff: a half, or higher if more than ``LOSS`` of
the held-out good documents would go.

The fit reads a bounded sample: ``LABELLED_ROWS`` labelled and ``POOL_ROWS``
unlabelled documents in expectation. All documents are scored.

Defined results: NULL text has no words; NULL metadata is a value of its own.
Labels repeated for a document count as bad if one is. Without labels of both
classes nothing is rejected and the score is 0. Rows are judged one by one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Memo, map_batches, map_rows
from .decontam import words
from .ftrl import Ftrl, scores, softmax, temperature
from .quality_rules import RULES, measure

WORDS = 1 << 16
META = 1 << 12
LABELLED_ROWS = 12_000
POOL_ROWS = 6_000
ROUNDS = 3
SURE = 0.97
#: At most this share of the pool passes from one view to the other per round.
GROWTH = 0.1
LOSS = 0.01


class Views:
    """Feature places of a document in both views."""

    def __init__(self) -> None:
        self.memo = Memo(lambda w: zlib.crc32(w) % WORDS)

    def text(self, text: str | None) -> np.ndarray:
        at = set(map(self.memo.__getitem__, words(text)))
        n, *_, shares = measure(text)
        at.add(zlib.crc32(b"size %d" % n.bit_length()) % WORDS)
        for rule, share in zip(RULES, shares):
            at.add(zlib.crc32(f"{rule} {share.bit_length()}".encode()) % WORDS)
        return np.fromiter(at, np.int64, len(at))

    @staticmethod
    def meta(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
        size = -1 if n_chars is None else max(0, n_chars).bit_length()
        names = (f"source {source}", f"lang {lang}", f"size {size}", f"both {source} {lang}")
        return np.unique([zlib.crc32(x.encode()) % META for x in names])


def _row(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at, np.ones(len(at))


class View:
    """One classifier: weights and temperature, good first and bad second."""

    def __init__(self, size: int, l1: float) -> None:
        self.size, self.l1, self.weights, self.heat = size, l1, np.zeros((size + 1, 2)), 1.0

    def fit(self, rows: list, labels: list[int], held: list, truth: list[int]) -> None:
        self.weights = Ftrl(self.size, 2, alpha=0.6, l1=self.l1, l2=0.1).fit(
            [_row(r) for r in rows], labels, epochs=3)
        raw = np.array([scores(self.weights, *_row(r)) for r in held]).reshape(-1, 2)
        self.heat = temperature(raw, np.array(truth, np.int64))

    def bad(self, at: np.ndarray) -> float:
        return float(softmax(scores(self.weights, *_row(at)) / self.heat)[1])


def _odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


class Model:
    def __init__(self, text: View, meta: View, prior: float, cutoff: float) -> None:
        self.text, self.meta, self.prior, self.cutoff = text, meta, prior, cutoff

    def __call__(self, at: np.ndarray, meta: np.ndarray) -> tuple[float, float, float]:
        a, b = self.text.bad(at), self.meta.bad(meta)
        return a, b, float(1 / (1 + np.exp(-(_odds(a) + _odds(b) - _odds(self.prior)))))


def _picks(view: View, pool: list[np.ndarray], taken: set[int], share: float) -> list[tuple[int, int]]:
    """Pool documents the view is most sure of, with its labels."""
    sure = sorted((-max(p, 1 - p), i, int(p > 0.5)) for i, at in enumerate(pool) if i not in taken
                  for p in [view.bad(at)] if max(p, 1 - p) >= SURE)
    return [(i, y) for _, i, y in sure[:int(share * len(pool))]]


def co_train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int],
             held: list[tuple[np.ndarray, np.ndarray]], truth: list[int],
             pool: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS,
             share: float = GROWTH, loss: float = LOSS) -> Model | None:
    """Fit both views on (text, meta) rows; None if the labels have one class."""
    if len(set(labels)) < 2:
        return None
    views = (View(WORDS, l1=5.0), View(META, l1=0.5))
    told: tuple[dict[int, int], dict[int, int]] = ({}, {})  # pool labels each view was given
    for turn in range(rounds + 1):
        for v, view in enumerate(views):
            view.fit([r[v] for r in rows] + [pool[i][v] for i in told[v]], labels + list(told[v].values()),
                     [r[v] for r in held], truth)
        if turn < rounds:
            for v, view in enumerate(views):
                told[1 - v].update(_picks(view, [p[v] for p in pool], set(told[1 - v]), share))
    model = Model(*views, prior=sum(labels) / len(labels), cutoff=0.5)
    good = sorted((model(*r)[2] for r, y in zip(held, truth) if not y), reverse=True)
    spare = int(loss * len(good))
    if len(good) > spare and good[spare] >= model.cutoff:
        model.cutoff = float(np.nextafter(good[spare], 2))
    return model


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS,
          pool_rows: int = POOL_ROWS) -> Model | None:
    bad = F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    known = (labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
             .groupBy("doc_id").agg(F.coalesce(bad, F.lit(0)).alias("bad")))
    n_known, n_all = known.count(), docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_000)) / 1e6
    keep = F.when(F.col("bad").isNull(), pool_rows / max(1, n_all - n_known)).otherwise(
        labelled_rows / max(1, n_known))
    # drawn on ids alone; the drawn ids, of bounded number, then pick the texts in one scan
    ids = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
           .join(known, "doc_id", "left").filter(draw < keep)
           .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(10)).cast("int")))
    sample = _columns(docs).join(F.broadcast(ids), "doc_id")

    def make():
        views = Views()

        def one(doc_id, text, source, lang, n_chars, bad, part):
            yield doc_id, -1 if bad is None else bad, part, sorted(views.text(text).tolist()), \
                views.meta(source, lang, n_chars).tolist()
        return one

    got = map_rows(sample.select("doc_id", "text", "source", "lang", "n_chars", "bad", "part"), make,
                   "doc_id long, bad int, part int, at array<int>, meta array<int>").orderBy("doc_id", "at")
    rows, y, held, truth, pool = [], [], [], [], []
    for r in got.toLocalIterator():
        row = (np.array(r.at, np.int64), np.array(r.meta, np.int64))
        if r.bad < 0:
            pool.append(row)
        elif r.part < 3:
            held.append(row)
            truth.append(r.bad)
        else:
            rows.append(row)
            y.append(r.bad)
    return co_train(rows, y, held, truth, pool)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.col("source").cast("string"), F.col("lang").cast("string"),
                       F.col("n_chars").cast("long"))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        views, m = Views(), shared.value

        def one(doc_id, text, source, lang, n_chars):
            if m is None:
                yield doc_id, 0.0, 0.0, 0.0, True
            else:
                a, b, p = m(views.text(text), views.meta(source, lang, n_chars))
                yield doc_id, a, b, p, p < m.cutoff
        return one

    return map_rows(_columns(docs), make, "doc_id long, text_score double, meta_score double, "
                                          "score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        views, m = Views(), shared.value

        def kept(batch):
            seen = zip(*(batch.column(batch.schema.get_field_index(c)) for c in
                         ("text", "source", "lang", "n_chars")))
            return batch.filter(pa.array(
                [m(views.text(t.as_py()), views.meta(s.as_py(), g.as_py(), n.as_py()))[2] < m.cutoff
                 for t, s, g, n in seen], pa.bool_()))
        return kept

    return map_batches(docs, make)
