"""Label algebra on ``array<string>`` / indicator / probability arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import ustrip


def parse_labels_raw(c: Column) -> Column:
    """Split on ``;`` and strip each token; blanks kept, NULL stays NULL."""
    return F.transform(F.split(c, ";"), ustrip)


def canonical(token: Column) -> Column:
    """Map an alias spelling to the vocabulary spelling."""
    return F.coalesce(F.try_element_at(vocab.alias_map(), token), token)


def parse_labels(c: Column) -> Column:
    """Tokens that are vocabulary labels, in written order (duplicates kept)."""
    vocab_arr = vocab.vocab_array()
    return F.filter(F.transform(parse_labels_raw(c), canonical),
                    lambda x: F.array_contains(vocab_arr, x))


def binarize(labels: Column) -> Column:
    """11 indicators in vocabulary order (duplicates collapse); NULL for NULL."""
    return F.when(labels.isNotNull(), F.transform(
        vocab.vocab_array(), lambda v: F.array_contains(labels, v).cast("int")))


def decode(indicators: Column) -> Column:
    """Indicators -> ``"; "``-joined names in vocabulary order; ``''`` if none."""
    picked = F.transform(vocab.vocab_array(),
                         lambda v, i: F.when(F.element_at(indicators, i + 1) == 1, v))
    return F.array_join(F.filter(picked, lambda x: x.isNotNull()), "; ")


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def thresholds(values: float | Sequence[float] | None) -> Column:
    """Scalar, per-label list, or default 0.5 -> array of 11 doubles."""
    if values is None:
        values = vocab.DEFAULT_THRESHOLD
    if isinstance(values, (int, float)):
        values = [float(values)] * len(vocab.LABELS)
    if len(values) != len(vocab.LABELS):
        raise ValueError(f"need {len(vocab.LABELS)} thresholds, got {len(values)}")
    return F.array(*[F.lit(float(v)) for v in values])


def above(probs: Column, thres: Column) -> Column:
    """Strictly-greater decision per position."""
    return F.zip_with(probs, thres, lambda p, t: (p > t).cast("int"))


def softmax(logits: Column) -> Column:
    """Max-shifted softmax over an array of doubles."""
    m = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda e: e / total)


def argmax(values: Column) -> Column:
    """0-based position of the maximum; first position on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def labels_equal(a: Column, b: Column) -> Column:
    """Case-insensitive equality as sets, with equal lengths."""
    la = F.transform(a, F.lower)
    lb = F.transform(b, F.lower)
    return ((F.array_sort(F.array_distinct(la)) == F.array_sort(F.array_distinct(lb)))
            & (F.size(a) == F.size(b)))
