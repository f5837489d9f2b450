"""Code to label translation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetcohort.settings import RISK_BANDS


def map_codes(code: Column, labels: dict) -> Column:
    """Label of a code from a small literal dictionary; unmapped codes give NULL."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.try_element_at(pairs, code)


def tier_rank(column: str) -> Column:
    """Ordinal tier; anything unknown or missing ranks lowest."""
    return F.expr(
        f"CASE {column} WHEN 'Diamond' THEN 4 WHEN 'Platinum' THEN 3 WHEN 'Gold' THEN 2 ELSE 1 END"
    )


def contains_any(text: Column, words: list[str]) -> Column:
    """1 when any word occurs in the text in any letter case, else 0 (NULL gives 0)."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.ilike(f"%{word}%")
    return F.when(hit, 1).otherwise(0)


def risk_band(probability: Column) -> Column:
    low, high = RISK_BANDS
    return F.when(probability < low, "low").when(probability < high, "medium").otherwise("high")
