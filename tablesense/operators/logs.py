"""What a log table says: breakdowns, recent rows, time buckets, spikes and their sources.

A log is a DataFrame plus the roles of its columns. Every filter is a plain predicate on the
source columns, so it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablesense.functions.privacy import message_template, redact_text
from tablesense.functions.timebuckets import GRAINS, bucket_label, bucket_parts

# Severities that mean a failure.
ERROR_SEVERITIES = ("ERROR", "FATAL", "SEVERE", "CRITICAL", "FAILED", "FAIL")


@dataclass(frozen=True)
class Roles:
    """Which column says when, how bad, where from and what."""

    when: str | None = None
    severity: str | None = None
    source: str | None = None
    message: str | None = None

    def columns(self) -> list[str]:
        return [c for c in (self.when, self.severity, self.source, self.message) if c]


def is_error(severity: Column) -> Column:
    return F.upper(severity).isin(*ERROR_SEVERITIES)


def all_of(predicates: Sequence[Column | None]) -> Column | None:
    """The conjunction of the predicates that are there; None when there are none."""
    given = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def since(log: DataFrame, when: str, hours: int | None, as_of: Column | None = None) -> Column | None:
    """``when`` within the last hours before ``as_of``, by default the latest time in the log."""
    if not hours or hours <= 0:
        return None
    moment = as_of if as_of is not None else log.agg(F.max(when)).scalar()
    return F.col(when) >= moment - F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def entries(
    log: DataFrame,
    roles: Roles,
    *,
    only_errors: bool = True,
    since_hours: int | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """The rows a question is about: failures unless all are asked for, within a window."""
    errors = is_error(F.col(roles.severity)) if only_errors and roles.severity else None
    window = since(log, roles.when, since_hours, as_of) if roles.when else None
    condition = all_of([errors, window])
    return log if condition is None else log.filter(condition)


def severity_breakdown(log: DataFrame, roles: Roles) -> DataFrame:
    counted = log.groupBy(F.col(roles.severity).alias("severity")).agg(F.count(F.lit(1)).alias("entries"))
    return counted.orderBy(F.desc("entries"))


def source_breakdown(log: DataFrame, roles: Roles, *, only_errors: bool = True) -> DataFrame:
    rows = entries(log, roles, only_errors=only_errors)
    counted = rows.groupBy(F.col(roles.source).alias("source")).agg(F.count(F.lit(1)).alias("entries"))
    return counted.orderBy(F.desc("entries"))


def role_columns(log: DataFrame, roles: Roles, *, message_chars: int | None = None) -> DataFrame:
    """Only the role columns, the message whole unless a length is given; a log without known roles is shown as it is."""
    if not roles.columns():
        return log
    kept = [F.col(c) for c in roles.columns() if c != roles.message]
    if roles.message:
        text = F.col(roles.message) if message_chars is None else F.substring(roles.message, 1, message_chars)
        kept.append(text.alias(roles.message))
    return log.select(*kept)


def recent_entries(
    log: DataFrame, roles: Roles, *, limit: int | None = None, only_errors: bool = True, tie_break: Sequence[str] = ()
) -> DataFrame:
    """The newest rows first, rows without a time before all others; all of them unless a limit is given."""
    rows = entries(log, roles, only_errors=only_errors)
    order = [F.desc_nulls_first(roles.when)] if roles.when else []
    order += [F.asc(c) for c in tie_break]
    rows = rows.orderBy(*order) if order else rows
    return role_columns(rows if limit is None else rows.limit(max(1, int(limit))), roles)


def bucket_counts(log: DataFrame, roles: Roles, *, grain: str = "hour", by_source: bool = False, **which) -> DataFrame:
    """(bucket[, source], entries): counts per time bucket; buckets without rows do not appear.

    Rows without a time have a bucket of their own, null, which the trend functions leave out.
    ``which`` goes to :func:`entries`. Grouping is on a date and an hour; the label is made after.
    """
    rows = entries(log, roles, **which)
    keys = bucket_parts(F.col(roles.when), grain)
    if by_source:
        keys = [*keys, F.col(roles.source).alias("source")]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"))
    names = ["bucket", "source", "entries"] if by_source else ["bucket", "entries"]
    return counted.withColumn("bucket", bucket_label(grain)).select(*names)


def roll_up_sources(by_source: DataFrame) -> DataFrame:
    """Counts per bucket from counts per bucket and source."""
    return by_source.groupBy("bucket").agg(F.sum("entries").alias("entries"))


def _timed(buckets: DataFrame) -> DataFrame:
    return buckets.filter(F.col("bucket").isNotNull())


def median_baseline(buckets: DataFrame) -> DataFrame:
    """The median count of the non-empty buckets, in one row; 0 when there are none."""
    return _timed(buckets).agg(F.coalesce(F.median("entries"), F.lit(0.0)).alias("baseline"))


def _ratio(baseline: Column) -> Column:
    return F.when(baseline > 0, F.bround(F.col("entries") / baseline, 1)).otherwise(F.col("entries").cast("double"))


def _against(df: DataFrame, buckets: DataFrame) -> DataFrame:
    """The baseline as a value beside every row with a time (a scalar subquery, not a join)."""
    return _timed(df).withColumn("baseline", median_baseline(buckets).scalar())


def spikes(buckets: DataFrame, *, factor: float = 3.0, min_count: int = 5) -> DataFrame:
    """Buckets that clear a floor and tower over the median."""
    baseline = F.col("baseline")
    high = (F.col("entries") >= min_count) & (F.col("entries") >= baseline * factor)
    found = _against(buckets, buckets).filter(high)
    return found.select("bucket", "entries", "baseline", _ratio(baseline).alias("ratio"))


def source_onsets(
    by_source: DataFrame, buckets: DataFrame, *, factor: float = 3.0, min_count: int = 5
) -> DataFrame:
    """Per source the first bucket in which it alone clears the bar of the whole log."""
    bar = F.greatest(F.lit(float(min_count)), F.col("baseline") * factor)
    over = _against(by_source, buckets).filter(F.col("entries") >= bar)
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    first = over.groupBy(source).agg(
        F.min("bucket").alias("bucket"), F.min_by("entries", "bucket").alias("entries"),
        F.first("baseline").alias("baseline"),
    )
    return first.select("source", "bucket", "entries", "baseline", _ratio(F.col("baseline")).alias("ratio"))


def spike_report(
    buckets: DataFrame, *, grain: str = "hour", only_errors: bool = True, factor: float = 3.0, min_count: int = 5
) -> DataFrame:
    """One row: totals, baseline, number of spikes and a remark on how far to trust them."""
    baseline = F.col("baseline")
    high = (F.col("entries") >= min_count) & (F.col("entries") >= baseline * factor)
    facts = _against(buckets, buckets).agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("bucket_count"),
        F.coalesce(F.first("baseline"), F.lit(0.0)).alias("baseline"),
        F.count_if(high).alias("spike_count"),
    )
    note = (
        F.when(F.col("bucket_count") == 0, "nothing in this window")
        .when(F.col("bucket_count") < 4, "few buckets: the baseline is rough")
        .when(F.col("spike_count") == 0, "no spikes: the volume stayed in its normal range")
        .otherwise("")
    )
    settings = {"grain": grain, "only_errors": only_errors, "factor": float(factor), "min_count": min_count}
    return facts.select("*", note.alias("note"), *[F.lit(v).alias(k) for k, v in settings.items()])


def peak(found: DataFrame) -> DataFrame:
    """The largest spike, the earliest of equals."""
    return found.orderBy(F.desc("entries"), F.asc("bucket")).limit(1)


def bucket_entries(
    log: DataFrame,
    roles: Roles,
    bucket: Column,
    *,
    grain: str = "hour",
    limit: int | None = None,
    only_errors: bool = True,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The newest rows of one time bucket. ``bucket`` is a label, or a scalar subquery giving one.

    The label becomes a range on the raw time column, so the scan skips everything else.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    time_type = log.schema[roles.when].dataType.typeName()
    start = bucket.cast(time_type) if grain == "hour" else bucket.cast("date").cast(time_type)
    length = F.make_dt_interval(F.lit(0), F.lit(1)) if grain == "hour" else F.make_dt_interval(F.lit(1))
    inside = log.filter((F.col(roles.when) >= start) & (F.col(roles.when) < start + length))
    return recent_entries(inside, roles, limit=limit, only_errors=only_errors, tie_break=tie_break)


def redact_entries(rows: DataFrame, message: str | None) -> DataFrame:
    """Rows with the message redacted and every other column untouched."""
    if not message or message not in rows.columns:
        return rows
    text = F.col(message)
    return rows.withColumn(message, F.when(text.isNotNull(), redact_text(text.cast("string"))))


def root_causes(log: DataFrame, roles: Roles, **which) -> DataFrame:
    """Messages that say the same thing, counted: template, count, typical severity, an example.

    Messages collapse per (template, severity) before the shuffle, so a cause with a third of all
    rows is a handful of rows by then.
    """
    rows = entries(log, roles, **which)
    message = F.col(roles.message)
    severity = F.col(roles.severity) if roles.severity else F.lit("")
    per_severity = (
        rows.select(message_template(message).alias("template"), severity.alias("severity"), redact_text(message).alias("text"))
        .groupBy("template", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("example"))
    )
    by_weight = F.struct(F.col("n"), F.col("severity"))
    return per_severity.groupBy("template").agg(
        F.sum("n").alias("entries"),
        F.max_by("severity", by_weight).alias("severity"),
        F.min("example").alias("example"),
    )


def log_query(log: DataFrame, roles: Roles, *, only_errors: bool = True, filters_severity: bool = False) -> DataFrame:
    """Rows for a request about errors: restricted to failures unless it filters severity itself."""
    return entries(log, roles, only_errors=only_errors and not filters_severity)

