"""Hour and day buckets of an event time, independent of the session time zone for NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GRAINS = ("hour", "day")


def bucket_parts(when: Column, grain: str) -> list[Column]:
    """Cheap grouping columns: a date, and the hour of day for hourly buckets."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    parts = [F.to_date(when).alias("bucket_day")]
    if grain == "hour":
        parts.append(F.hour(when).alias("bucket_hour"))
    return parts


def bucket_label(grain: str) -> Column:
    """'2024-01-15 07:00' or '2024-01-15', from the columns of :func:`bucket_parts`."""
    day = F.col("bucket_day").cast("string")
    if grain == "day":
        return day
    return F.concat(day, F.lit(" "), F.lpad(F.col("bucket_hour").cast("string"), 2, "0"), F.lit(":00"))


def bucket_of(when: Column, grain: str) -> Column:
    """The label of one time value, for row filters."""
    return F.substring(when.cast("string"), 1, 10) if grain == "day" else F.concat(
        F.substring(when.cast("string"), 1, 13), F.lit(":00")
    )
