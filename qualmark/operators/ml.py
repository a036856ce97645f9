"""Error identifier and label verifier: linear text models trained in passes.

The identifier has one head per vocabulary label, the verifier a single one;
``operators.passes`` trains all heads together, keeps the pass with the best
dev metric and stops when it no longer improves. Inference adds logits in Arrow
batches; what follows (sigmoid, thresholds, decoding) is JVM-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import labels as lb
from . import passes
from .metrics import best_thresholds, f1_from_counts, threshold_list
from .passes import NUM_FEATURES, LinearModel


@dataclass
class TextModel:
    """A trained model and the dev score of each pass; ``kept`` is the pass whose
    state it holds (None without dev rows)."""

    model: LinearModel
    history: list[tuple[int, float]] = field(default_factory=list)

    @property
    def kept(self) -> int | None:
        return max(self.history, key=lambda h: (h[1], -h[0]))[0] if self.history else None

    def logits(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return self.model.logits(df, text_col)


def micro_f1(scored: DataFrame, thresholds: float | Sequence[float] | None = None) -> float:
    """Micro-F1 of ``y`` (indicators) against ``logits``: what ``multilabel_metrics``
    gives, from three sums."""
    pred = scored.select("y", lb.above(lb.sigmoid(F.col("logits")), lb.thresholds(thresholds)).alias("p"))

    def total(values):
        return F.coalesce(F.sum(F.aggregate(values, F.lit(0), lambda a, x: a + x)), F.lit(0))

    tp = total(F.zip_with("y", "p", lambda y, p: y * p))
    f1 = f1_from_counts(tp, total(F.col("p")) - tp, total(F.col("y")) - tp)
    return pred.agg(F.round(f1, 6).alias("f1")).first()["f1"]


def binary_f1(scored: DataFrame) -> float:
    """F1 of the positive class, ``y`` and ``logits`` of one head."""
    y, p = F.col("y")[0] == 1, F.col("logits")[0] > 0
    f1 = f1_from_counts(F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p))
    return scored.agg(F.round(f1, 6).alias("f1")).first()["f1"]


def train_identifier(train: DataFrame, dev: DataFrame | None = None, text_col: str = "text",
                     labels_col: str = "labels", reg_param: float = 0.0, max_passes: int | None = None,
                     patience: int = passes.PATIENCE, num_features: int = NUM_FEATURES,
                     key: str = "item_id") -> TextModel:
    """One head per vocabulary label, best dev micro-F1 kept."""
    return TextModel(*passes.fit(train, lb.binarize(F.col(labels_col)), len(vocab.LABELS), dev, micro_f1, text_col,
                                 key, max_passes, patience, reg=reg_param, num_features=num_features))


def identify_errors(model: TextModel, df: DataFrame,
                    thresholds: float | Sequence[float] | None = None,
                    out_col: str = "pred_error", need_prob: bool = False) -> DataFrame:
    """Adds ``pred_error`` (``"; "``-joined labels in vocabulary order, ``''``
    if none) and, with ``need_prob``, one ``<Label>_prob`` column per label."""
    x = model.logits(df)
    probs = lb.sigmoid(F.col("logits"))
    x = x.withColumn("_probs", probs)
    x = x.withColumn(out_col, lb.decode(lb.above(F.col("_probs"), lb.thresholds(thresholds))))
    if need_prob:
        for i, lab in enumerate(vocab.LABELS):
            x = x.withColumn(f"{lab}_prob", F.col("_probs")[i])
    keep = [c for c in df.columns if c != out_col] + [out_col] + (
        [f"{lab}_prob" for lab in vocab.LABELS] if need_prob else [])
    return x.select(*keep)


def tune_thresholds(model: TextModel, dev: DataFrame, labels_col: str = "labels") -> list[float]:
    """The best cutoff of each label on dev rows (``metrics.best_thresholds``), as
    ``identify_errors`` takes them. The comparison there is strict, as here."""
    scored = model.logits(dev).select(lb.sigmoid(F.col("logits")).alias("probs"),
                                      lb.binarize(F.col(labels_col)).alias("y_true"))
    return threshold_list(best_thresholds(scored.filter(F.col("y_true").isNotNull())))


def identify_row(model: TextModel, question: str, answer: str, passage: str, model_type: str = "roberta",
                 thresholds: float | Sequence[float] | None = None) -> tuple[str, list[float]]:
    """Label string and probabilities of one triple, without a job."""
    import math
    from .prompts import identifier_text_of
    limits = thresholds if isinstance(thresholds, (list, tuple)) else \
        [vocab.DEFAULT_THRESHOLD if thresholds is None else float(thresholds)] * len(vocab.LABELS)
    probs = [1 / (1 + math.exp(-x)) for x in model.model.score_text(
        identifier_text_of(question, answer, passage, model_type))]
    return "; ".join(name for name, p, t in zip(vocab.LABELS, probs, limits) if p > t), probs


def train_verifier(train: DataFrame, dev: DataFrame | None = None, text_col: str = "text",
                   label_col: str = "label", reg_param: float = 0.0, max_passes: int | None = None,
                   patience: int = passes.PATIENCE, num_features: int = NUM_FEATURES,
                   key: str = "item_id") -> TextModel:
    """One head for "are these labels right?", best dev F1 kept."""
    label = F.col(label_col).cast("int")
    target = F.when(label.isNotNull(), F.array(label))
    return TextModel(*passes.fit(train, target, 1, dev, binary_f1, text_col, key, max_passes, patience,
                                 reg=reg_param, num_features=num_features))


def verify_labels(model: TextModel, df: DataFrame) -> DataFrame:
    """Adds ``verify_label`` (argmax, class 0 on ties) and ``positive_prob``."""
    x = model.logits(df)
    p = lb.softmax(F.array(F.lit(0.0), F.col("logits")[0]))
    x = x.withColumn("_p", p).withColumn("positive_prob", F.col("_p")[1])
    return x.select(*df.columns, lb.argmax(F.col("_p")).alias("verify_label"), "positive_prob")


def select_best(candidates: dict[float, TextModel]) -> tuple[TextModel, list[tuple[float, int, float]]]:
    """The candidate with the best dev score at its kept pass (the first of equal
    ones), and [(reg_param, kept pass, score)]."""
    scores = [(reg, m.kept, max(s for _, s in m.history)) for reg, m in candidates.items()]
    top = max(s for _, _, s in scores)
    return candidates[next(reg for reg, _, s in scores if s == top)], scores


def select_model(train: DataFrame, dev: DataFrame, reg_params: Sequence[float] = (0.0, 0.01, 0.1), **options):
    """Verifier regularisation by dev F1: (best model, [(reg_param, kept pass, f1)])."""
    return select_best({float(r): train_verifier(train, dev, reg_param=r, **options) for r in reg_params})


def select_identifier(train: DataFrame, dev: DataFrame, reg_params: Sequence[float] = (0.0, 0.01), **options):
    """Identifier regularisation by dev micro-F1: (best model, [(reg_param, kept pass, micro_f1)])."""
    return select_best({float(r): train_identifier(train, dev, reg_param=r, **options) for r in reg_params})
