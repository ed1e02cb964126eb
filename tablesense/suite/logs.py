"""Log queries over ``events``: its type is the severity, its user the source, its props the message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesense.functions.grading import parse_window
from tablesense.operators import logs
from tablesense.plans.log_report import spike_analysis, spike_rows
from tablesense.suite.estate import table
from tablesense.suite.registry import query

ROLES = logs.Roles(when="ts", severity="event_type", source="user_id", message="props")
_ERRORS = "upper(event_type) IN ('ERROR', 'FATAL', 'SEVERE', 'CRITICAL', 'FAILED', 'FAIL')"
_HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M')"
_DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d')"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users gathered into five sources."""
    return _events(spark, sf_dir).withColumn("user_id", F.col("user_id") % 5)


@query("A7", "SELECT event_type AS severity, count(*) AS entries FROM events GROUP BY 1")
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.severity_breakdown(_events(spark, sf_dir), ROLES)


@query("A8 P1", f"SELECT user_id AS source, count(*) AS entries FROM events WHERE {_ERRORS} GROUP BY 1")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.source_breakdown(_events(spark, sf_dir), ROLES)


@query(
    "P1 P2 P3 F13",
    f"SELECT event_id, ts::VARCHAR AS at, user_id FROM events WHERE {_ERRORS} "
    "AND ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR",
)
def errors_of_last_48_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.entries(_events(spark, sf_dir), ROLES, since_hours=parse_window("48h"))
    return rows.select("event_id", F.col("ts").cast("string").alias("at"), "user_id")


@query(
    "T2 P5 M10 T1",
    f"SELECT ts::VARCHAR AS ts, event_type, user_id, props FROM events "
    f"WHERE {_ERRORS} ORDER BY events.ts DESC NULLS FIRST, event_id LIMIT 50",
)
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.recent_entries(_events(spark, sf_dir), ROLES, limit=50, tie_break=["event_id"])
    return rows.withColumn("ts", F.col("ts").cast("string"))


@query("A9 F12", f"SELECT {_HOUR} AS bucket, count(*) AS entries FROM events WHERE {_ERRORS} GROUP BY 1")
def hourly_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bucket_counts(_events(spark, sf_dir), ROLES)


@query("A9 F12", f"SELECT {_DAY} AS bucket, count(*) AS entries FROM events GROUP BY 1")
def daily_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bucket_counts(_events(spark, sf_dir), ROLES, grain="day", only_errors=False)


@query(
    "A10",
    f"SELECT {_DAY} AS bucket, user_id AS source, count(*) AS entries FROM events WHERE {_ERRORS} GROUP BY 1, 2",
)
def daily_errors_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bucket_counts(_events(spark, sf_dir), ROLES, grain="day", by_source=True)


_BUCKETS = f"SELECT {_HOUR} AS bucket, count(*) AS entries FROM events WHERE {_ERRORS} AND ts IS NOT NULL GROUP BY 1"


@query("A11", f"SELECT median(entries) AS baseline FROM ({_BUCKETS})")
def median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.median_baseline(logs.bucket_counts(_events(spark, sf_dir), ROLES))


_SPIKES = (
    f"WITH b AS ({_BUCKETS}), m AS (SELECT median(entries) AS baseline FROM b) "
    "SELECT bucket, entries, baseline, round_even(entries / baseline, 1) AS ratio FROM b, m "
    "WHERE entries >= 5 AND entries >= 3 * baseline"
)


@query("A12 A10 M8 M9", _SPIKES)
def error_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spike_analysis(_events(spark, sf_dir), ROLES)["spikes"]


@query(
    "A13",
    f"WITH e AS (SELECT {_HOUR} AS bucket, user_id % 5 AS source FROM events WHERE {_ERRORS} AND ts IS NOT NULL), "
    "m AS (SELECT median(n) AS baseline FROM (SELECT count(*) AS n FROM e GROUP BY bucket)), "
    "s AS (SELECT bucket, source, count(*) AS entries FROM e GROUP BY 1, 2) "
    "SELECT coalesce(CAST(source AS VARCHAR), '') AS source, bucket, entries, baseline, round_even(entries / baseline, 1) AS ratio "
    "FROM s, m WHERE entries >= greatest(3, baseline * 1.0) "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY bucket) = 1",
)
def source_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spike_analysis(_coarse(spark, sf_dir), ROLES, factor=1.0, min_count=3)["onsets"]


def _report_sql(buckets: str, grain: str, only_errors: bool) -> str:
    return (
        f"WITH b AS ({buckets}), m AS (SELECT median(entries) AS baseline FROM b), f AS (SELECT "
        "CAST(sum(entries) AS BIGINT) AS total, count(*) AS bucket_count, max(baseline) AS baseline, "
        "count(*) FILTER (entries >= 5 AND entries >= 3 * baseline) AS spike_count FROM b, m) "
        "SELECT *, CASE WHEN bucket_count = 0 THEN 'nothing in this window' "
        "WHEN bucket_count < 4 THEN 'few buckets: the baseline is rough' "
        "WHEN spike_count = 0 THEN 'no spikes: the volume stayed in its normal range' ELSE '' END AS note, "
        f"'{grain}' AS grain, {str(only_errors).upper()} AS only_errors, 3.0::DOUBLE AS factor, 5 AS min_count FROM f"
    )


@query("A14", _report_sql(_BUCKETS, "hour", True))
def spike_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spike_analysis(_events(spark, sf_dir), ROLES)["report"]


@query("A14", _report_sql(f"SELECT {_DAY} AS bucket, count(*) AS entries FROM events WHERE ts IS NOT NULL GROUP BY 1", "day", False))
def daily_report_without_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spike_analysis(_events(spark, sf_dir), ROLES, grain="day", only_errors=False)["report"]


@query(
    "A15 P4",
    f"WITH sp AS ({_SPIKES}), p AS (SELECT bucket FROM sp ORDER BY entries DESC, bucket LIMIT 1) "
    f"SELECT ts::VARCHAR AS ts, event_type, user_id, props FROM events WHERE {_ERRORS} "
    f"AND {_HOUR} = (SELECT bucket FROM p)",
)
def peak_spike_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spike_rows(_events(spark, sf_dir), ROLES, tie_break=("event_id",))
    return rows.withColumn("ts", F.col("ts").cast("string"))


@query(
    "P4",
    f"SELECT ts::VARCHAR AS ts, event_type, user_id, props FROM events WHERE {_DAY} = '2024-01-15' "
    "ORDER BY events.ts DESC, event_id LIMIT 20",
)
def day_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.bucket_entries(
        _events(spark, sf_dir), ROLES, F.lit("2024-01-15"), grain="day", limit=20, only_errors=False,
        tie_break=["event_id"],
    )
    return rows.withColumn("ts", F.col("ts").cast("string"))


@query(
    "A24 F5",
    "SELECT template, count(*) AS entries, 'error' AS severity, min(props) AS example FROM "
    rf"(SELECT props, trim(regexp_replace(regexp_replace(props, '\d+', '<n>', 'g'), '\s+', ' ', 'g')) AS template "
    f"FROM events WHERE {_ERRORS}) GROUP BY 1",
)
def error_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.root_causes(_events(spark, sf_dir), ROLES)


_CHAT = logs.Roles(severity="role", source="conv_id", message="text")
_CHAT_TEXT = rf"regexp_replace(text, '\b\d[\d -]{{5,}}\d\b', '<number>', 'g')"


@query(
    "A24",
    "WITH t AS (SELECT trim(regexp_replace(regexp_replace(r, '\\d+', '<n>', 'g'), '\\s+', ' ', 'g')) AS template, "
    f"role, r FROM (SELECT role, {_CHAT_TEXT} AS r FROM conversations)), "
    "s AS (SELECT template, role, count(*) AS n FROM t GROUP BY 1, 2) "
    "SELECT md5(t.template) AS template_md5, count(*) AS entries, (SELECT role FROM s WHERE s.template = t.template "
    "ORDER BY n DESC, role DESC LIMIT 1) AS severity, md5(min(r)) AS example_md5 FROM t GROUP BY t.template",
)
def repeated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversation turns that say the same once numbers and spacing are levelled."""
    found = logs.root_causes(table(spark, sf_dir, "conversations"), _CHAT, only_errors=False)
    return found.select(
        F.md5("template").alias("template_md5"), "entries", "severity", F.md5("example").alias("example_md5")
    )


@query(
    "P8",
    f"SELECT 'default' AS request, count(*) AS entries FROM events WHERE {_ERRORS} UNION ALL "
    "SELECT 'all entries', count(*) FROM events UNION ALL "
    "SELECT 'own severity filter', count(*) FROM events WHERE event_type = 'signup'",
)
def error_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request about errors is restricted to failures unless it says otherwise."""
    events = _events(spark, sf_dir)
    requests = {
        "default": logs.log_query(events, ROLES),
        "all entries": logs.log_query(events, ROLES, only_errors=False),
        "own severity filter": logs.log_query(
            events.filter("event_type = 'signup'"), ROLES, filters_severity=True
        ),
    }
    counted = [
        rows.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("request"), "entries")
        for name, rows in requests.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
