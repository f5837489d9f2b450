"""Reproducible draws: every value is a function of (seed, stream, row key).

Draws do not depend on partitioning, retries or run order, and any engine with
md5 can reproduce them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**32)


def digest(seed: int, stream: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{stream}:"), key.cast("string")))


def uniform(hashed: Column, part: int = 0) -> Column:
    """Open-interval uniform from the ``part``-th group of eight hex digits (0-3)."""
    word = F.conv(F.substring(hashed, part * 8 + 1, 8), 16, 10).cast("double")
    return (word + 0.5) / _SPAN


def draw(seed: int, stream: str, key: Column) -> Column:
    return uniform(digest(seed, stream, key))


def standard_normal(seed: int, stream: str, key: Column) -> Column:
    """Box-Muller on two words of one digest."""
    hashed = digest(seed, stream, key)
    radius = F.sqrt(F.ln(uniform(hashed, 0)) * -2.0)
    return radius * F.cos(uniform(hashed, 1) * (2.0 * math.pi))


def exponential(seed: int, stream: str, key: Column, scale: float) -> Column:
    return F.ln(F.lit(1.0) - draw(seed, stream, key)) * -scale


def in_share(seed: int, stream: str, key: Column, share: float) -> Column:
    """Stable membership: true for about ``share`` of all keys."""
    return draw(seed, stream, key) < share
