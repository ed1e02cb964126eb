"""The registered queries: complete registration, and a few of them against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare
from tablesense.suite import REGISTRY

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")

INVENTORY = (
    "S1 S2 S3 S5 S6 S8 S9 S10 S11 S12 P1 P2 P3 P4 P5 P6 P7 P8 P9 J1 J2 J3 J4 J5 J6 J7 J8 J9 J10 J11 J12 J13 J14 J15 "
    "J16 J17 J18 J19 J20 A1 A2 A3 A4 A5 A6 A7 A8 A9 A10 A11 A12 A13 A14 A15 A16 A17 A18 A19 A20 A21 A22 A23 A24 A25 "
    "W1 W2 W3 T1 T2 T3 T4 T5 U1 U2 U3 U4 F1 F2 F3 F4 F5 F6 F7 F8 F9 F10 F11 F12 F13 F14 F15 F17 C1 C2 C3 C4 C5 C6 C7 C8 "
    "R1 R2 R3 R4 R5 G1 G2 G3 G4 G5 G6 G7 B1 B2 B3 B4 B5 B6 B7 B8 B9 B10 B11 B12 B13"
).split()


def test_every_operator_has_a_query():
    covered = {op for q in REGISTRY.values() for op in q.covers.split()}
    assert not set(INVENTORY) - covered


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize(
    "name", ["value_overlap", "fk_discovery", "contact_shapes", "error_spikes", "document_relevance", "settlement", "declared_routines"]
)
def test_query_agrees_with_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SMALL, t)}.parquet'")
    line = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert line.startswith("ok"), line
