"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader (elastic net) and
calibrated by temperature.

Document frequencies are counted over all training documents. The weights are
fitted on a sample of their distinct texts, ``SAMPLE_ROWS`` in expectation and
shared equally among the languages, however often a text occurs; a fifth of the sample is kept for the temperature. Only
text and language of training documents are read for that.

Defined results: a text that is NULL, empty or without letters gets ``und`` and
score 0. Without any labelled training text every text gets ``und``; with one
language every text with letters gets that one. Ties go to the language that
sorts first. Rows are judged one by one, repeated or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import in_python, map_rows
from .ftrl import Ftrl, scores, softmax, temperature

BUCKETS = 1 << 15
ORDERS = 3
SAMPLE_ROWS = 6000
EPOCHS = 2
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed character n-grams of orders 1 to ``ORDERS`` with their counts;
    everything but letters is one blank. None without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32).astype(np.uint64)
    code = np.concatenate([[32], code, [32]]).astype(np.uint64)
    code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))]
    total = np.zeros(BUCKETS, np.int64)
    gram = np.zeros(len(code), np.uint64)
    for order in range(1, ORDERS + 1):
        n = len(code) - order + 1
        if n <= 0:
            break
        gram = gram[:n] * np.uint64(0x100000001B3) + code[order - 1:order - 1 + n]
        mixed = (gram + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def weigh(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts
    value = (1 + np.log(n)) * idf[at]
    return at, value / max(1e-12, float(np.sqrt(value @ value)))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each bucket, over all rows; a task sends its sums only."""
    def run(batches):
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                got = term_counts(text.as_py())
                if got is not None:
                    df[got[0]] += 1
                    n += 1
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "n"])

    sums = in_python(texts.select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in sums.toLocalIterator():  # one row per bucket
        df[r.at] = r.n
    return df[:BUCKETS], int(df[BUCKETS])


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float) -> None:
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = term_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(scores(self.weights, *weigh(counts, self.idf)) / self.heat)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Model:
    """``labelled``: text and lang of the training documents."""
    known = labelled.filter("text is not null and lang is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    texts = known.select("lang", F.xxhash64("text").alias("key")).distinct()
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    each = sample_rows / len(languages)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, each / sizes[lang]))])
    draw = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_000)) / 1e6
    drawn = known.filter(draw < share[F.col("lang")]).select("text", "lang").distinct()
    sample = map_rows(drawn, _counts_of,
                      "lang string, split int, at array<int>, n array<int>").orderBy("split", "lang", "at")
    rows, labels, held, truth = [], [], [], []
    for r in sample.toLocalIterator():
        row = weigh((np.array(r.at), np.array(r.n)), idf)
        (held if r.split == 0 else rows).append(row)
        (truth if r.split == 0 else labels).append(languages.index(r.lang))
    weights = Ftrl(BUCKETS, len(languages)).fit(rows, labels, epochs)
    raw = np.array([scores(weights, *row) for row in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, temperature(raw, np.array(truth, np.int64)))


def _counts_of():
    import zlib

    def one(text, lang):
        got = term_counts(text)
        if got is not None:
            yield lang, zlib.crc32(text.encode()) % 5, got[0].tolist(), got[1].tolist()
    return one


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model_ = shared.value

        def one(doc_id, text):
            yield doc_id, *model_(text)
        return one

    return map_rows(docs.select("doc_id", F.col("text").cast("string")), make,
                    "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
