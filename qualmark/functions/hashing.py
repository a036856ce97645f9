"""Seeded, engine-independent pseudo-randomness from md5.

``md5(seed|key)`` gives the same bits on every engine and every run, unlike
``rand()`` whose stream depends on partitioning; that keeps splits and draws
stable under task retry and repartitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def md5_u32(seed: int | str, *keys: Column) -> Column:
    """First 32 bits of ``md5('seed|k1|k2...')`` as a non-negative long."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def md5_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return md5_u32(seed, *keys) / F.lit(TWO_POW_32)
