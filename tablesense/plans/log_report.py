"""The trend report of a log: one pass over its rows, everything else from the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablesense.operators import logs


def spike_analysis(
    log: DataFrame, roles: logs.Roles, *, grain: str = "hour", factor: float = 3.0, min_count: int = 5, **which
) -> dict[str, DataFrame]:
    """buckets, spikes, onsets and report. Buckets are rolled up from the counts per source, so the
    log is scanned for one aggregation that the frames share."""
    only_errors = which.get("only_errors", True)
    onsets = None
    if roles.source:
        by_source = logs.bucket_counts(log, roles, grain=grain, by_source=True, **which)
        buckets = logs.roll_up_sources(by_source)
        onsets = logs.source_onsets(by_source, buckets, factor=factor, min_count=min_count)
    else:
        buckets = logs.bucket_counts(log, roles, grain=grain, **which)
    frames = {
        "buckets": buckets.orderBy("bucket"),
        "spikes": logs.spikes(buckets, factor=factor, min_count=min_count).orderBy("bucket"),
        "report": logs.spike_report(
            buckets, grain=grain, only_errors=only_errors, factor=factor, min_count=min_count
        ),
    }
    if onsets is not None:
        frames["onsets"] = onsets.orderBy("bucket", "source")
    return frames


def spike_rows(
    log: DataFrame, roles: logs.Roles, *, grain: str = "hour", limit: int | None = None, factor: float = 3.0,
    min_count: int = 5, tie_break: tuple[str, ...] = (), **which,
) -> DataFrame:
    """The newest rows of the largest spike."""
    buckets = logs.bucket_counts(log, roles, grain=grain, **which)
    label = logs.peak(logs.spikes(buckets, factor=factor, min_count=min_count)).select("bucket").scalar()
    only_errors = which.get("only_errors", True)
    return logs.bucket_entries(
        log, roles, label, grain=grain, limit=limit, only_errors=only_errors, tie_break=tie_break
    )
