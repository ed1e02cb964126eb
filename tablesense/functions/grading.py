"""Confidence grades, evidence sentences and forgiving casts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

HIGH, MEDIUM, LOW = "high", "medium", "low"


def overlap_confidence(overlap: Column) -> Column:
    """High from 99 % on, else medium; low where nothing could be measured."""
    return F.when(overlap.isNull(), LOW).when(overlap >= 0.99, HIGH).otherwise(MEDIUM)


def percent(fraction: Column) -> Column:
    """0.9967 -> '100%', rounding halves to even."""
    return F.concat(F.bround(fraction * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def count_or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_window(text: str | None) -> int | None:
    """'48h', '7d' or a bare number of hours -> hours; anything else -> None."""
    found = re.fullmatch(r"(\d+)\s*([hd]?)", (text or "").strip().lower())
    if not found:
        return None
    amount, unit = int(found[1]), found[2]
    return amount * (24 if unit == "d" else 1)
