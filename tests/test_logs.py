"""Log breakdowns, buckets, spikes and the recognition of log tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablesense.functions.grading import parse_window
from tablesense.operators import logroles, logs
from tablesense.plans.log_report import spike_analysis, spike_rows
from tablesense.sources.catalog import COLUMN_SCHEMA, CONSTRAINT_SCHEMA
from tablesense.sources.tables import local_rows

ROLES = logs.Roles(when="at", severity="level", source="module", message="msg")
START = dt.datetime(2026, 1, 1)


@pytest.fixture
def log(make):
    def build(counts, level="ERROR"):
        """(hour, module, number of rows) to a log."""
        rows = [
            (i, START + dt.timedelta(hours=h, minutes=i % 60), level, m, f"order {i} failed for jane@corp.example")
            for h, m, n in counts for i in range(n)
        ]
        return make(rows, "id int, at timestamp_ntz, level string, module string, msg string")

    return build


def test_spikes_and_baseline(log):
    found = spike_analysis(log([(h, "A", 1) for h in range(10)] + [(10, "B", 18)]), ROLES)
    spike = found["spikes"].collect()
    assert [(s["bucket"], s["entries"], s["baseline"], s["ratio"]) for s in spike] == [("2026-01-01 10:00", 18, 1.0, 18.0)]
    report = found["report"].collect()[0]
    assert (report["total"], report["bucket_count"], report["spike_count"], report["note"]) == (28, 11, 1, "")


def test_rows_without_a_time_are_counted_but_no_trend(log):
    rows = log([(h, "A", 1) for h in range(6)]).unionByName(log([(0, "B", 40)]).withColumn("at", F.lit(None).cast("timestamp_ntz")))
    counts = {r["bucket"]: r["entries"] for r in logs.bucket_counts(rows, ROLES).collect()}
    assert counts[None] == 40 and len(counts) == 7
    found = spike_analysis(rows, ROLES)
    assert found["spikes"].count() == 0 and found["onsets"].count() == 0
    assert found["report"].collect()[0]["total"] == 6


def test_small_counts_never_spike(log):
    buckets = logs.bucket_counts(log([(0, "A", 1), (1, "A", 1), (2, "A", 1), (3, "A", 4)]), ROLES)
    assert logs.spikes(buckets).count() == 0


def test_notes(log, make):
    def note(counts):
        return spike_analysis(log(counts), ROLES)["report"].collect()[0]["note"]

    assert note([]) == "nothing in this window"
    assert note([(0, "A", 2), (1, "A", 9)]).startswith("few buckets")
    assert note([(h, "A", 3) for h in range(6)]).startswith("no spikes")


def test_median_of_an_even_number_of_buckets(log):
    buckets = logs.bucket_counts(log([(0, "A", 1), (1, "A", 2), (2, "A", 3), (3, "A", 10)]), ROLES)
    assert logs.median_baseline(buckets).collect()[0]["baseline"] == 2.5


def test_onset_is_the_first_bucket_of_a_source(log):
    counts = [(h, "ORDERS", 1) for h in range(6)] + [(4, "PAY", 18), (5, "PAY", 12)]
    onsets = spike_analysis(log(counts), ROLES)["onsets"].collect()
    assert [(o["source"], o["bucket"], o["entries"]) for o in onsets] == [("PAY", "2026-01-01 04:00", 18)]


def test_unknown_source_is_the_empty_one(make):
    rows = [(START, "ERROR", None, "m")] * 6
    log = make(rows, "at timestamp_ntz, level string, module string, msg string")
    onsets = spike_analysis(log, ROLES, factor=1.0)["onsets"].collect()
    assert [o["source"] for o in onsets] == [""]


def test_only_errors_unless_all_are_asked_for(log):
    mixed = log([(0, "A", 3)]).unionByName(log([(0, "A", 2)], level="info")).unionByName(log([(0, "A", 1)], level="fatal"))
    assert logs.entries(mixed, ROLES).count() == 4
    assert logs.entries(mixed, ROLES, only_errors=False).count() == 6
    assert {r["severity"]: r["entries"] for r in logs.severity_breakdown(mixed, ROLES).collect()} == {"ERROR": 3, "info": 2, "fatal": 1}


def test_window_ends_at_the_given_or_the_latest_time(log):
    rows = log([(h, "A", 1) for h in range(10)])
    assert logs.entries(rows, ROLES, since_hours=3).count() == 4
    as_of = F.lit(START + dt.timedelta(hours=20)).cast("timestamp_ntz")
    assert logs.entries(rows, ROLES, since_hours=3, as_of=as_of).count() == 0
    assert logs.entries(rows, ROLES, since_hours=0).count() == 10


def test_recent_rows_are_bounded_and_null_times_come_first(make):
    rows = [(i, START + dt.timedelta(hours=i), "ERROR", "x" * 3000) for i in range(5)] + [(9, None, "ERROR", "y")]
    log = make(rows, "id int, at timestamp_ntz, level string, msg string")
    roles = logs.Roles(when="at", severity="level", message="msg")
    recent = logs.recent_entries(log, roles, limit=3).collect()
    assert [r["at"] for r in recent] == [None, START + dt.timedelta(hours=4), START + dt.timedelta(hours=3)]
    assert len(recent[1]["msg"]) > 2000
    assert logs.recent_entries(log, roles, limit=0).count() == 1
    assert logs.recent_entries(log, logs.Roles(), limit=2).columns == log.columns


def test_rows_of_the_peak(log):
    rows = spike_rows(log([(h, "A", 1) for h in range(8)] + [(8, "B", 6), (9, "C", 7)]), ROLES)
    assert {r["module"] for r in rows.collect()} == {"C"} and rows.count() == 7


def test_day_buckets_and_bad_grains(log):
    rows = log([(1, "A", 2), (30, "A", 1)])
    assert {r["bucket"]: r["entries"] for r in logs.bucket_counts(rows, ROLES, grain="day").collect()} == {"2026-01-01": 2, "2026-01-02": 1}
    with pytest.raises(ValueError):
        logs.bucket_counts(rows, ROLES, grain="minute")


def test_root_causes_and_redaction(log):
    causes = logs.root_causes(log([(0, "A", 5), (1, "B", 4)]), ROLES).collect()
    assert [(c["entries"], c["severity"]) for c in causes] == [(9, "ERROR")]
    assert "jane@corp" not in causes[0]["example"]
    redacted = logs.redact_entries(log([(0, "A", 1)]), "msg").collect()[0]
    assert "j***@c***.example" in redacted["msg"] and redacted["module"] == "A"


@pytest.mark.parametrize("text, hours", [("48h", 48), ("7d", 168), ("12", 12), (" 3 D ", 72), ("soon", None), ("", None), (None, None)])
def test_windows(text, hours):
    assert parse_window(text) == hours


# ------------------------------------------------------------------ recognition


@pytest.fixture
def catalog(spark):
    def build(tables, foreign=()):
        """{table: (columns as 'NAME:TYPE[:LENGTH]', primary key)} to columns and constraints."""
        columns, constraints = [], []
        for name, (cols, key) in tables.items():
            for i, c in enumerate(cols.split(), start=1):
                column, kind, *length = c.split(":")
                columns.append(("APP", name, i, column, kind, int(length[0]) if length else None, None, None, True, None))
            constraints.append(("APP", name, f"PK_{name}", "P", [key], None, None, None))
        constraints += [("APP", t, f"FK_{t}", "R", [c], "APP", p, [c]) for t, c, p in foreign]
        return local_rows(spark, columns, COLUMN_SCHEMA), local_rows(spark, constraints, CONSTRAINT_SCHEMA)

    return build


ERROR_LOG = (
    "ERROR_ID:NUMBER LOG_TIME:TIMESTAMP(6) SEVERITY:VARCHAR2:10 ERROR_CODE:NUMBER MODULE:VARCHAR2:60 "
    "MESSAGE:VARCHAR2:2000 DB_USER:VARCHAR2:30 ORDER_ID:NUMBER", "ERROR_ID",
)
AUDIT = (
    "AUDIT_ID:NUMBER EVENT_TIME:TIMESTAMP(6) ACTION:VARCHAR2:20 OBJECT_NAME:VARCHAR2:30 ROW_PK:NUMBER "
    "CHANGED_BY:VARCHAR2:30 DETAILS:CLOB", "AUDIT_ID",
)
JOB = (
    "RUN_ID:NUMBER JOB_NAME:VARCHAR2:60 STARTED_AT:TIMESTAMP(6) FINISHED_AT:TIMESTAMP(6) STATUS:VARCHAR2:20 "
    "ROWS_PROCESSED:NUMBER ERROR_TEXT:VARCHAR2:2000", "RUN_ID",
)


def test_log_tables_and_their_kinds(catalog):
    found = logroles.log_tables(*catalog({
        "ERROR_LOG": ERROR_LOG, "AUDIT_TRAIL": AUDIT, "JOB_RUN_LOG": JOB,
        "APP_ORDERS": ("ORDER_ID:NUMBER CUSTOMER_ID:NUMBER ORDER_DATE:DATE STATUS:VARCHAR2:20 TOTAL_AMT:NUMBER", "ORDER_ID"),
    }, foreign=[("ERROR_LOG", "ORDER_ID", "APP_ORDERS")])).collect()
    assert {(r["table"], r["kind"], r["confidence"]) for r in found} == {
        ("ERROR_LOG", "error", "high"), ("AUDIT_TRAIL", "audit", "high"), ("JOB_RUN_LOG", "job", "high"),
    }
    roles = {c["column"]: c["role"] for r in found if r["table"] == "ERROR_LOG" for c in r["columns"]}
    assert roles == {
        "LOG_TIME": "event_time", "SEVERITY": "severity", "ERROR_CODE": "code", "MODULE": "source",
        "MESSAGE": "message", "DB_USER": "actor", "ORDER_ID": "business_ref",
    }


def test_a_ledger_is_no_log_but_a_plain_wide_text_with_a_time_is(catalog):
    ledger = "TXN_ID:NUMBER CUSTOMER_ID:NUMBER CREATED_AT:TIMESTAMP AMOUNT:NUMBER DETAILS:VARCHAR2:100"
    notes = "ID:NUMBER CREATED_AT:TIMESTAMP REMARK:VARCHAR2:400"
    short = "ID:NUMBER CREATED_AT:TIMESTAMP REMARK:VARCHAR2:399"
    found = logroles.log_tables(*catalog({"TRANSACTIONS": (ledger, "TXN_ID"), "DIARY": (notes, "ID"), "CARDS": (short, "ID")}))
    assert [(r["table"], r["kind"], r["confidence"]) for r in found.collect()] == [("DIARY", "generic", "medium")]


def test_the_surest_error_log_is_the_default(catalog):
    found = logroles.log_tables(*catalog({"AUDIT_TRAIL": AUDIT, "ERROR_LOG": ERROR_LOG, "JOB_RUN_LOG": JOB}))
    assert logroles.choose_log(found).collect()[0]["table"] == "ERROR_LOG"
    assert logroles.choose_log(found, "app.job_run_log").collect()[0]["table"] == "JOB_RUN_LOG"
    assert logroles.choose_log(found, "nothing").count() == 0
