"""Sources, sinks, program texts and what depends on what."""

import glob
import os

from pyspark.sql import functions as F

from tablesense.operators import deps
from tablesense.sources import catalog, programs, sinks
from tablesense.sources.tables import capped, read_parquet, row_page


def test_parquet_source_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumn("x", F.col("id") * 2).withColumn("y", F.lit("a")).write.parquet(path)
    df = read_parquet(spark, path, columns=["x"], where=F.col("id") > 90)
    assert df.count() == 9
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "y:string" not in plan


def test_constraints_resolve_across_owners(make):
    constraints = make([
        ("A", "PK_P", "P", "P", None, None), ("B", "FK_C", "C", "R", "A", "PK_P"), ("B", "FK_X", "C", "R", "Z", "GONE"), ("B", "CK", "C", "X", None, None),
    ], "owner string, name string, table string, kind string, ref_owner string, ref_name string")
    columns = make([("A", "PK_P", "k2", 2), ("A", "PK_P", "k1", 1), ("B", "FK_C", "c1", 1), ("B", "FK_C", "c2", 2)],
                   "owner string, name string, column string, position int")
    rows = {r["name"]: r for r in catalog.resolve_constraints(constraints, columns).collect()}
    assert rows["PK_P"]["columns"] == ["k1", "k2"]
    assert (rows["FK_C"]["ref_table"], rows["FK_C"]["ref_columns"]) == ("P", ["k1", "k2"])
    assert rows["FK_X"]["ref_table"] is None and "CK" not in rows


def test_application_owners(make):
    tables = make([("SYS",), ("HR",), ("APEX_1",), ("HR",)], "owner string")
    assert [r[0] for r in catalog.application_owners(tables).collect()] == ["HR"]
    users = make([("HR", "N"), ("SYS", "Y"), ("EMPTY", "N")], "owner string, maintained string")
    assert [r[0] for r in catalog.application_owners(tables, users).collect()] == ["HR"]


def test_estate_selection_and_types(estate):
    sources = estate({
        ("B", "T2"): ([(1, 1.5, "x")], "a int, b double, c string", {"large_text": ("c",)}), ("A", "T1"): ([], "z bigint", {}),
        ("B", "T1"): ([], "z date", {}),
    })
    assert sources.keys() == [("B", "T1"), ("B", "T2"), ("A", "T1")]
    assert sources.only("A").keys() == [("A", "T1")]
    types = {(r["table"], r["column"]): (r["data_type"], r["precision"]) for r in sources.only("B").columns().collect()}
    assert types == {("T1", "z"): ("DATE", None), ("T2", "a"): ("NUMBER", 10), ("T2", "b"): ("BINARY_DOUBLE", None), ("T2", "c"): ("CLOB", None)}
    assert catalog.profilable_columns(sources, "B", "T2") == ["a", "b"]
    assert {(r["owner"], r["table"]): r["num_rows"] for r in sources.row_counts().collect()} == {("B", "T1"): 0, ("B", "T2"): 1, ("A", "T1"): 0}


def test_type_signatures(make):
    from tablesense.functions.names import base_type, type_signature

    df = make([("number", None, 10, 2), ("NUMBER", None, 10, None), ("NUMBER", None, None, None), ("VARCHAR2", 64, None, None), ("DATE", 7, None, None), ("NUMBER", None, None, 3)],
              "t string, l int, p int, s int")
    signature = type_signature(*[F.col(c) for c in "tlps"])
    rows = df.select(signature.alias("g"), base_type(signature).alias("b")).collect()
    assert [r["g"] for r in rows] == ["NUMBER(10,2)", "NUMBER(10,0)", "NUMBER", "VARCHAR2(64)", "DATE", "NUMBER(*,3)"]
    assert {r["b"] for r in rows} == {"NUMBER", "VARCHAR2", "DATE"}


def test_report_round_trip(spark, make, tmp_path):
    frames = {"edges": make([("a", ["x", "y"], None)], "t string, c array<string>, n long")}
    sinks.write_report(frames, str(tmp_path))
    back = sinks.read_report(spark, str(tmp_path), {"edges": frames["edges"].schema})
    assert back["edges"].collect() == frames["edges"].collect()


def test_csv_quoting_and_line_ends(make, tmp_path):
    df = make([(1, 'say "hi", ok'), (2, "two\nlines"), (3, None), (4, "plain")], "n int, t string")
    lines = [r[0] for r in df.orderBy("n").select(sinks.csv_line(["n", "t"])).collect()]
    assert lines == ['1,"say ""hi"", ok"', '2,"two\nlines"', "3,", "4,plain"]
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    parts = [glob.glob(os.path.join(str(tmp_path / "csv"), n, "part-*"))[0] for n in ("header", "rows")]
    text = "".join(open(p, newline="").read() for p in parts)
    assert text == 'n,t\r\n' + "\r\n".join(lines) + "\r\n"


def test_grid_sorting_is_numeric_aware(make):
    df = make([("10",), ("9",), (None,), ("b",), ("a",)], "v string")
    assert [r[0] for r in sinks.sort_grid(df, "v").collect()] == ["9", "10", "a", "b", None]
    assert [r[0] for r in sinks.sort_grid(df, "v", ascending=False).collect()][:1] == [None]


def test_pages_and_caps(spark):
    rows, full = row_page(spark.range(5), 3)
    assert len(rows) == 3 and full and not row_page(spark.range(2), 3)[1]
    assert [capped(spark.range(5), n).collect()[0][0] for n in (5, 6)] == [True, False]


SPEC = "PACKAGE p AS\n  PROCEDURE open_it(x NUMBER);\n  FUNCTION balance RETURN NUMBER;\n  PROCEDURE open_it(y DATE);\nEND;\n"
BODY = (
    "PACKAGE BODY p AS\n  PROCEDURE hidden IS BEGIN null; END;\n  PROCEDURE open_it(x NUMBER) IS BEGIN UPDATE loans SET a = 1; END;\n"
    "  FUNCTION balance RETURN NUMBER IS BEGIN SELECT 1 FROM loans_archive; END;\nEND;\n"
)


def source_lines(make):
    lines = [("S", "P", "PACKAGE", i, t + "\n") for i, t in enumerate(SPEC.splitlines())]
    lines += [("S", "P", "PACKAGE BODY", i, t + "\n") for i, t in enumerate(BODY.splitlines())]
    lines += [("S", "LOANS", "PROCEDURE", 1, "begin loans; end;")]
    return make(list(reversed(lines)), "owner string, name string, type string, line int, text string")


def units(make):
    return programs.assemble_source(source_lines(make), {"PACKAGE": "PACKAGE", "PROCEDURE": "PROCEDURE"})


def test_sources_are_assembled_in_order(make):
    rows = {r["name"]: r for r in units(make).collect()}
    assert rows["P"]["source"] == (SPEC + BODY).strip() and rows["P"]["kind"] == "PACKAGE"


def test_long_units_are_assembled_over_stretches(make):
    lines = make([("S", "U", "PROCEDURE", i, f"{i};") for i in range(3500)], "owner string, name string, type string, line int, text string")
    assert programs.assemble_source(lines).collect()[0]["source"] == "".join(f"{i};" for i in range(3500))


def test_triggers_and_overview(make):
    trigger = programs.trigger_units(make([("S", "T1", "INSERT", "LOANS", " head ", None)], "owner string, name string, event string, table string, header string, body string"))
    assert trigger.collect()[0]["source"] == "-- INSERT ON LOANS\nhead"
    summaries = make([("S", "T1", "TRIGGER", "guards loans", "high")], "owner string, name string, kind string, summary string, confidence string")
    objects = make([("s", "t1", "trigger", "INVALID")], "owner string, name string, type string, status string")
    row = programs.program_overview(trigger, summaries, objects).collect()[0]
    assert (row["summary"], row["status"]) == ("guards loans", "INVALID")


def test_routines_declared_and_referencing(make):
    found = deps.declared_routines(units(make)).orderBy("position").collect()
    assert [(r["routine"], r["routine_kind"]) for r in found] == [("OPEN_IT", "PROCEDURE"), ("BALANCE", "FUNCTION")]
    names = make([("LOANS",), ("Loans_Archive",)], "identifier string")
    refs = {(r["routine"], r["identifier"]) for r in deps.routine_references(units(make), names).collect()}
    assert refs == {("OPEN_IT", "LOANS"), ("BALANCE", "Loans_Archive")}
    users = {(r["identifier"], r["name"]) for r in deps.usages(units(make), names).collect()}
    assert users == {("LOANS", "P"), ("Loans_Archive", "P")}  # LOANS does not use itself


def test_tables_in_queries(make):
    df = make([(1, "select * from A.b join c on 1=1, d"), (2, "SELECT 1")], "query int, sql string")
    assert {(r["query"], r["table"]) for r in deps.referenced_tables(df).collect()} == {(1, "B"), (1, "C")}
    asked = make([(1, "select sum(x) from a"), (2, "with a as (select sum(x)) select 1"), (3, "select x from a")], "query int, sql string")
    assert [r["query"] for r in deps.aggregating(asked).collect()] == [1]


def test_unknown_names_and_risks(make):
    scripts = make([(1, "a.ACTIVE = 1 -- b.HIDDEN\n and a . STATUS = core.get_it()")], "script int, code string")
    known, packages = make([("status",)], "name string"), make([("CORE",)], "name string")
    assert [r["name"] for r in deps.unknown_references(scripts, known, packages).collect()] == ["ACTIVE"]
    code = make([
        (1, "drop table t"), (2, "delete from t"), (3, "delete from t where a = 1"), (4, "-- drop table t\nselect 1"),
        (5, "procedure p is begin null; end;"), (6, "create procedure p is begin null; end;"),
    ], "script int, code string")
    risks = {(r["script"], r["risk"]) for r in deps.risky_scripts(code).collect()}
    assert risks == {(1, "drops an object"), (2, "changes every row"), (5, "is only the body of a routine")}


def test_ground_truth(estate):
    from tablesense.sources.catalog import ground_truth

    sources = estate({
        ("S", "P"): ([], "K int", {"primary_key": ("K",), "comment": " about "}),
        ("S", "C"): ([], "K int", {"foreign_keys": ((("K",), "S", "P", ("K",)),), "column_comments": {"K": "key"}}),
    })
    rows = {r["table"]: r for r in ground_truth(sources.tables(), sources.columns(), sources.constraints()).collect()}
    assert rows["P"]["comment"] == "about" and rows["P"]["foreign_keys"] is None
    assert rows["C"]["column_comments"] == {"K": "key"} and rows["C"]["foreign_keys"][0]["to_table"] == "P"


def test_usages_find_names_with_marks_within_longer_names(make):
    lines = make(
        [("S", "USER1", "PROCEDURE", 1, "select A$B$C from dual"), ("S", "PKG", "PACKAGE BODY", 1, "procedure A$B is begin x#y_1; end;"), ("S", "USER2", "PROCEDURE", 1, "A$$B")],
        "owner string, name string, type string, line int, text string",
    )
    whole = programs.assemble_source(lines)
    names = make([("A$B",), ("B$C",), ("A$B$C",), ("x#y_1",), ("A$C",)], "identifier string")
    found = {(r["identifier"], r["name"]) for r in deps.usages(whole, names).collect()}
    assert found == {("A$B", "USER1"), ("B$C", "USER1"), ("A$B$C", "USER1"), ("A$B", "PKG"), ("x#y_1", "PKG")}
    own = make([("A$B", "PKG")], "identifier string, package string")
    assert ("A$B", "PKG") not in {(r["identifier"], r["name"]) for r in deps.usages(whole, names, own).collect()}


def test_lines_give_what_units_give(make):
    lines, whole = source_lines(make), units(make)
    names = make([("LOANS",), ("Loans_Archive",), ("begin",), ("return",), ("end",)], "identifier string")
    found = deps.declared_routines_in_lines(lines).orderBy("position").collect()
    assert [(r["routine"], r["routine_kind"]) for r in found] == [("OPEN_IT", "PROCEDURE"), ("BALANCE", "FUNCTION")]
    want = {tuple(r) for r in deps.routine_references(whole, names).collect()}
    for block in (1, 2, 3, 10_000):
        assert {tuple(r) for r in deps.routine_references_in_lines(lines, names, lines_per_block=block).collect()} == want
    users = {(r["identifier"], r["name"]) for r in deps.usages(whole, names).collect()}
    assert {(r["identifier"], r["name"]) for r in deps.usages_in_lines(lines, names).collect()} == users


def test_a_long_unit_is_scanned_in_blocks(spark):
    """Each routine's name is found some thousand lines above its only mention, over many blocks; lines may be null."""
    text = (
        "case when id % 5000 = 0 then concat('  Procedure r', id div 5000, ' is x', id div 5000, '\\n') when id % 5000 = 4999 then 'call target;' "
        "when id = 60001 then 'PACKAGE body; function late return t' when id % 7 = 0 then null else 'null;' end"
    )
    lines = spark.range(0, 100_000, 1, 4).selectExpr("'S' as owner", "'BIG' as name", "if(id < 60000, 'PACKAGE', 'PACKAGE BODY') as type", "id as line", f"{text} as text")
    names = spark.createDataFrame([("TARGET",), ("x3",)], "identifier string")
    found = {(r["routine"], r["identifier"]) for r in deps.routine_references_in_lines(lines, names, lines_per_block=700).collect()}
    assert found == {(f"R{i}", "TARGET") for i in range(20)} | {("R3", "x3")}
    declared = [r["routine"] for r in deps.declared_routines_in_lines(lines).orderBy("position").collect()]
    assert declared == [f"R{i}" for i in range(13)]  # up to the words package body, in a line of their own type
    empty = lines.limit(0)
    assert deps.declared_routines_in_lines(empty).count() == deps.routine_references_in_lines(empty, names).count() == deps.usages_in_lines(empty, names).count() == 0
    plan = deps.routine_references_in_lines(lines, names)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_csv_files_round_trip(spark, make, tmp_path):
    rows = [
        (1, 'a\nb "q", c', "x"), (2, None, "l\r\nast\n"), (3, "", "plain"), (4, " lead ", "tail "), (5, '\\"esc\\', "#c"),
        (6, "ü\r", "\n"), (7, '"', '"""'), (None, "x\\", "y"), (1, 'a\nb "q", c', "x"), (8, "long " * 50_000, ","),
    ]
    schema = "a long, b string, line string"
    sinks.write_csv(make(rows, schema).repartition(3), str(tmp_path / "grid"))
    found = [tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "grid"), schema).collect()]
    assert sorted(found, key=str) == sorted(((a, b or None, c) for a, b, c in rows), key=str)
    sinks.write_csv(make([], schema), str(tmp_path / "empty"))
    assert sinks.read_csv(spark, str(tmp_path / "empty"), schema).count() == 0


def test_rows_of_a_word_in_every_script_are_dealt_out(spark):
    """All scripts name E.X: no task gets a large part of their rows, and the result is that of a plain check."""
    scripts = spark.range(4000).selectExpr("id as script", "concat('select e.x, e.y', id % 3, ', q.z', id, ' from pkg_', id % 5, '.run()') as code")
    known = spark.createDataFrame([("Y1",), ("z7",)], "name string")
    programs = spark.createDataFrame([("PKG_0",), ("PKG_1",), ("pkg_2",), ("PKG_3",), ("PKG_4",), ("Q",)], "name string")
    want = {(i, "X") for i in range(4000)} | {(i, f"Y{i % 3}") for i in range(4000) if i % 3 != 1}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for hot_rows in (100, 1_000_000):
            found = [tuple(r) for r in deps.unknown_references(scripts, known, programs, hot_rows=hot_rows).collect()]
            assert len(found) == len(want) and set(found) == want
        rows = deps.unresolved(scripts, known, programs, hot_rows=100)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.4 * sum(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_references_behind_their_header_are_not_put_in_order(make):
    """Hits in the row of their header need no window; hits in other rows do, also in units without an owner."""
    schema = "owner string, name string, type string, line int, text string"
    names = make([("T1",), ("T2",)], "identifier string")
    own = make([("S", "P", "BODY", i, f"procedure r{i} is begin T{i}; end;\n") for i in (1, 2, 3)], schema)
    found = deps.routine_references_in_lines(own, names)
    assert {tuple(r) for r in found.collect()} == {("S", "P", "R1", "T1"), ("S", "P", "R2", "T2")}
    assert "Window" not in found._jdf.queryExecution().toString()
    loose = make([(None, "P", "BODY", 1, "procedure r1 is\n"), (None, "P", "BODY", 2, "begin t1; end;\nprocedure r2 is t2;\n"), (None, "P", "BODY", 3, "t1")], schema)
    found = [tuple(r) for r in deps.routine_references_in_lines(loose, names).collect()]
    assert sorted(r[1:] for r in found) == [("P", "R1", "T1"), ("P", "R2", "T1"), ("P", "R2", "T2")]


def test_rows_of_one_place_keep_their_own_header(make):
    """Lines without a number have no order among each other; each hit still belongs to the header in its row."""
    lines = make([("S", "P", "BODY", None, "procedure r1 is t1;\n"), ("S", "P", "BODY", None, "procedure r2 is t2;\n")], "owner string, name string, type string, line int, text string")
    names = make([("t1",), ("t2",)], "identifier string")
    found = [tuple(r) for r in deps.routine_references_in_lines(lines, names).collect()]
    assert sorted(found) == [("S", "P", "R1", "t1"), ("S", "P", "R2", "t2")]
