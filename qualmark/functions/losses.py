"""Element-wise classification losses over logit/target arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def bce_with_logits(x: Column, y: Column, pos_weight: Column | None = None) -> Column:
    """Stable sigmoid cross-entropy for scalar logit ``x`` and target ``y``.

    With ``pos_weight`` w: ``(1-y)*x + (1+(w-1)*y) * softplus(-x)``.
    """
    softplus_neg = F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    if pos_weight is None:
        return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return (F.lit(1.0) - y) * x + (F.lit(1.0) + (pos_weight - F.lit(1.0)) * y) * softplus_neg


def focal(x: Column, y: Column, alpha: float = vocab.FOCAL_ALPHA,
          gamma: float = vocab.FOCAL_GAMMA) -> Column:
    bce = bce_with_logits(x, y)
    pt = F.exp(-bce)
    return F.lit(alpha) * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * bce
