"""Shapes of what is released: samples by key, Laplace noise, small groups withheld."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_sample(key: Column, fraction: float) -> Column:
    """A fixed fraction by the key's SHA-256, so that every query sees the same rows."""
    head = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double")
    return F.coalesce(head < F.lit(fraction * 2**32), F.lit(False))


def laplace(scale: float, seed: int | None = None) -> Column:
    u = (F.rand(seed) if seed is not None else F.rand()) - 0.5
    return -scale * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def withheld(answer: DataFrame, k: int) -> DataFrame:
    """All of ``answer``, or nothing of it if it has less than ``k`` rows; held, so that what is counted is what is released."""
    answer = answer.persist(StorageLevel.DISK_ONLY)
    return answer if answer.limit(k).count() >= k else answer.limit(0)
