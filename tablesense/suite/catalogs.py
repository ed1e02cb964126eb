"""Catalog queries: sources, sinks, findings, log tables and meanings, with the facts measured."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesense.functions.names import name_contains, type_signature
from tablesense.operators import findings, logroles, meaning
from tablesense.operators.inclusion import inclusion
from tablesense.plans import fk_discovery
from tablesense.plans.table_profile import profile_estate
from tablesense.session import shared_dir
from tablesense.sources import catalog, programs, sinks
from tablesense.sources.tables import local_rows, settled
from tablesense.suite import estate as given_tables
from tablesense.suite.estate import COMMENTS, KEYS, LARGE_TEXT, OWNERS, TRUTH, table
from tablesense.suite.registry import query

_OWNER_OF = {name: owner for owner, names in OWNERS.items() for name in names}
_LISTED = ", ".join(f"'{t}'" for t in _OWNER_OF)
_OWNER_CASE = "CASE " + " ".join(
    f"WHEN table_name IN ({', '.join(repr(t) for t in names)}) THEN '{owner}'" for owner, names in OWNERS.items()
) + " END"
_CLOB = " OR ".join(f"(table_name = '{t}' AND column_name = '{cols[0]}')" for t, cols in LARGE_TEXT.items())
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}" for t in _OWNER_OF)
_COLUMN_COMMENTS = ", ".join(
    f"('{t}', '{c}', '{text}')" for t, (_, cols) in COMMENTS.items() for c, text in cols.items()
)
_TABLE_COMMENTS = ", ".join(f"('{t}', '{text}')" for t, (text, _) in COMMENTS.items() if text)
# The catalog of the given tables as SQL sees it.
_CATALOG = f"""
    catalog AS (
        SELECT {_OWNER_CASE} AS owner, table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name,
               CASE WHEN {_CLOB} THEN 'CLOB' WHEN data_type = 'BIGINT' THEN 'NUMBER' WHEN data_type = 'INTEGER' THEN 'NUMBER'
                    WHEN data_type = 'DOUBLE' THEN 'BINARY_DOUBLE' WHEN data_type = 'VARCHAR' THEN 'VARCHAR2'
                    WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE 'ARRAY<FLOAT>' END AS data_type,
               CASE data_type WHEN 'BIGINT' THEN '(19,0)' WHEN 'INTEGER' THEN '(10,0)' ELSE '' END AS digits
        FROM information_schema.columns WHERE table_name IN ({_LISTED})
    ),
    counts AS ({_COUNTS}),
    column_comments AS (SELECT * FROM (VALUES {_COLUMN_COMMENTS}) v(table_name, column_name, comment)),
    table_comments AS (SELECT * FROM (VALUES {_TABLE_COMMENTS}) v(table_name, comment))
"""


# ------------------------------------------------------------------ sources and sinks


@query(
    "S2 S6 F7 U1",
    f"WITH {_CATALOG} SELECT owner, table_name AS \"table\", ordinal, column_name AS \"column\", "
    "data_type || digits AS signature, c.comment, num_rows FROM catalog "
    "LEFT JOIN column_comments c USING (table_name, column_name) JOIN counts USING (table_name)",
)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged catalog of all owners with comments and measured row counts."""
    estate = given_tables.given(spark, sf_dir)
    owners = {o: estate.only(o).columns().drop("owner") for o in OWNERS}
    signature = type_signature(*[F.col(c) for c in ("data_type", "length", "precision", "scale")])
    merged = catalog.merge_catalogs(owners).join(estate.row_counts(), ["owner", "table"])
    return merged.select("owner", "table", "ordinal", "column", signature.alias("signature"), "comment", "num_rows")


@query(
    "S6 S12",
    " UNION ALL ".join(
        f"SELECT '{target}' AS target, count(*) AS tables, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM "
        f"({' UNION ALL '.join(f'SELECT count(*) AS num_rows FROM {t}' for t in names)})"
        for target, names in (
            ("all", list(_OWNER_OF)), ("one", OWNERS["APP"]), ("several", OWNERS["APP"] + OWNERS["CORPUS"]),
        )
    ),
)
def scan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All owners, one, and a list."""
    estate = given_tables.given(spark, sf_dir)
    targets = {
        "all": estate.only("*"), "one": estate.only("APP"), "several": estate.only(["APP", "CORPUS"]),
    }
    parts = [
        e.row_counts().agg(F.count(F.lit(1)).alias("tables"), F.sum("num_rows").alias("num_rows"))
        .select(F.lit(name).alias("target"), "tables", "num_rows")
        for name, e in targets.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _dictionary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The keys and references of the given tables as dictionary rows."""
    rows, parts = [], []
    for name, key in KEYS.items():
        rows.append((_OWNER_OF[name], f"PK_{name}", name, "P", None, None))
        parts += [(_OWNER_OF[name], f"PK_{name}", c, i) for i, c in enumerate(key, start=1)]
    for child, column, parent in TRUTH:
        rows.append((_OWNER_OF[child], f"FK_{child}_{column}", child, "R", _OWNER_OF[parent], f"PK_{parent}"))
        parts.append((_OWNER_OF[child], f"FK_{child}_{column}", column, 1))
    return (
        local_rows(spark, rows, "owner string, name string, table string, kind string, ref_owner string, ref_name string"),
        local_rows(spark, parts, "owner string, name string, column string, position int"),
    )


@query(
    "S3",
    " UNION ALL ".join(
        f"SELECT 'FK_{c}_{col}' AS name, '{c}' AS \"table\", '{col}' AS columns, '{p}' AS ref_table, "
        f"'{KEYS[p][0]}' AS ref_columns, (SELECT count(*) FROM {c} x WHERE x.{col} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {p} y WHERE y.{KEYS[p][0]} = x.{col})) AS orphan_rows" for c, col, p in TRUTH
    ),
)
def constraint_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys with their resolved targets, and how many rows break each."""
    estate = given_tables.given(spark, sf_dir)
    resolved = catalog.resolve_constraints(*_dictionary(spark)).filter("kind = 'R'")
    pairs = resolved.select(
        "name", "owner", "table", "columns", F.col("ref_owner").alias("parent_owner"),
        F.col("ref_table").alias("parent_table"), F.col("ref_columns").alias("parent_columns"),
    )
    measured = inclusion({k: s.rows for k, s in estate.sources.items()}, pairs)
    return measured.select(
        "name", "table", F.array_join("columns", "+").alias("columns"), F.col("parent_table").alias("ref_table"),
        F.array_join("parent_columns", "+").alias("ref_columns"), "orphan_rows",
    )


@query(
    "S5",
    "SELECT s_name AS owner FROM supplier WHERE s_acctbal >= 0 AND EXISTS "
    "(SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)",
)
def application_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as owners, the indebted ones as the system's own; what they delivered as tables."""
    supplier = table(spark, sf_dir, "supplier")
    users = supplier.select(
        F.col("s_name").alias("owner"), F.when(F.col("s_acctbal") < 0, "Y").otherwise("N").alias("maintained")
    )
    owned = table(spark, sf_dir, "lineitem").join(
        supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("owner")), "l_suppkey"
    )
    return catalog.application_owners(owned.select("owner"), users)


_OWNER_NAMES = (
    "SELECT CASE WHEN n_regionkey = 0 THEN 'SYSTEM' WHEN n_regionkey = 1 THEN 'APEX_' || n_name "
    "ELSE upper(n_name) END AS owner FROM customer JOIN nation ON n_nationkey = c_nationkey"
)


@query("S5", f"SELECT DISTINCT owner FROM ({_OWNER_NAMES}) WHERE owner <> 'SYSTEM' AND NOT starts_with(owner, 'APEX_')")
def application_owners_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = F.col("n_regionkey")
    owner = (
        F.when(region == 0, "SYSTEM").when(region == 1, F.concat(F.lit("APEX_"), "n_name")).otherwise(F.upper("n_name"))
    )
    customers = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return catalog.application_owners(customers.select(owner.alias("owner")))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as source texts: turns are lines, roles are the parts of a unit."""
    lines = table(spark, sf_dir, "conversations").select(
        F.lit("APP").alias("owner"), F.col("conv_id").cast("string").alias("name"), F.col("role").alias("type"),
        F.col("turn").alias("line"), "text",
    )
    return programs.assemble_source(lines, {"assistant": "PACKAGE", "system": "FUNCTION"})


_UNITS = (
    "SELECT 'APP' AS owner, CAST(conv_id AS VARCHAR) AS name, CASE min(role) WHEN 'assistant' THEN 'PACKAGE' "
    "WHEN 'system' THEN 'FUNCTION' ELSE 'PROCEDURE' END AS kind, "
    "trim(string_agg(text, '' ORDER BY role, turn), ' \t\n\r') AS source FROM conversations GROUP BY conv_id"
)


@query("S8", f"SELECT owner, name, kind, length(source) AS chars, md5(source) AS source_md5 FROM ({_UNITS})")
def assembled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select(
        "owner", "name", "kind", F.length("source").cast("bigint").alias("chars"), F.md5("source").alias("source_md5")
    )


@query(
    "S8 U1",
    f"SELECT kind, name, md5(source) AS source_md5 FROM ({_UNITS}) UNION ALL SELECT 'TRIGGER', 'T' || event_id, "
    "md5('-- ' || upper(event_type) || ' ON USER_' || user_id || chr(10) || props) FROM events UNION ALL "
    "SELECT 'VIEW', url, md5(trim(html, ' \t\n\r')) FROM pages",
)
def all_program_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of program text as one frame."""
    owner = F.lit("APP").alias("owner")
    triggers = table(spark, sf_dir, "events").select(
        owner, F.concat(F.lit("T"), "event_id").alias("name"), F.upper("event_type").alias("event"),
        F.concat(F.lit("USER_"), "user_id").alias("table"), F.lit("  ").alias("header"), F.col("props").alias("body"),
    )
    views = table(spark, sf_dir, "pages").select(owner, F.col("url").alias("name"), F.col("html").alias("text"))
    units = programs.program_units(
        _units(spark, sf_dir), programs.trigger_units(triggers), programs.view_units(views)
    )
    return units.select("kind", "name", F.md5("source").alias("source_md5"))


@query(
    "J20",
    f"WITH u AS ({_UNITS}), s AS (SELECT CAST(conv_id AS VARCHAR) AS name, md5(text) AS summary FROM conversations "
    "WHERE turn = 1 AND role = 'assistant'), o AS (SELECT CAST(conv_id AS VARCHAR) AS name, CASE WHEN count(*) % 2 = 0 "
    "THEN 'VALID' ELSE 'INVALID' END AS status FROM conversations GROUP BY conv_id) "
    "SELECT u.name, u.kind, coalesce(CASE WHEN u.kind = 'PACKAGE' THEN summary END, '') AS summary, "
    "coalesce(CASE WHEN u.kind = 'PACKAGE' THEN status END, '') AS status "
    "FROM u LEFT JOIN s USING (name) LEFT JOIN o USING (name)",
)
def program_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    name, package = F.col("conv_id").cast("string").alias("name"), F.lit("PACKAGE")
    summaries = turns.filter("turn = 1 AND role = 'assistant'").select(
        F.lit("APP").alias("owner"), name, package.alias("kind"), F.md5("text").alias("summary"),
        F.lit("medium").alias("confidence"),
    )
    even = F.count(F.lit(1)) % 2 == 0
    objects = turns.groupBy("conv_id").agg(
        F.when(even, "VALID").otherwise("INVALID").alias("status")
    ).select(F.lit("app").alias("owner"), name, F.lit("package").alias("type"), "status")
    found = programs.program_overview(_units(spark, sf_dir), summaries, objects)
    return found.select("name", "kind", "summary", "status")


def _sink_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query(
    "S9",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def report_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of one frame, written as JSON files and read back by its schema."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = _sink_folder(spark, "report")
    sinks.write_report({"orders": rows}, path)
    return sinks.read_report(spark, path, {"orders": rows.schema})["orders"]


@query("S10", "SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns, line breaks and quotes included, written as CSV files and read back; empty cells become null."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = _sink_folder(spark, "turns")
    sinks.write_csv(turns, path)
    return sinks.read_csv(spark, path, turns.schema)


def _cell_sql(col: str) -> str:
    text = f"coalesce(CAST({col} AS VARCHAR), '')"
    return (
        f"CASE WHEN contains({text}, ',') OR contains({text}, '\"') OR contains({text}, chr(10)) OR "
        f"contains({text}, chr(13)) THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"
    )


@query(
    "S10",
    "SELECT conv_id, turn, md5(" + " || ',' || ".join(map(_cell_sql, ("conv_id", "turn", "role", "text")))
    + ") AS line_md5 FROM conversations",
)
def csv_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as CSV lines: quotes doubled, cells quoted only where needed."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.md5(sinks.csv_line(["conv_id", "turn", "role", "text"])).alias("line_md5"))


@query("T4", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name")
def grid_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return sinks.sort_grid(parts, "p_size", ascending=False, tie_break=["p_name"])


@query("P9", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.org')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").filter(name_contains(F.col("url"), " Example.ORG "))


# ------------------------------------------------------------------ findings


@query(
    "A16",
    "SELECT 'department_id has several types: NUMBER in departments, employees; VARCHAR2 in contacts.' AS message, "
    "(SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS num_rows",
)
def type_inconsistencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of one name and several types, with the rows of the tables concerned."""
    estate = given_tables.staff(spark, sf_dir)
    columns = estate.columns()
    found = findings.type_inconsistencies(columns).select("message", F.explode("columns").alias("column"))
    concerned = columns.select("owner", "table", "column").join(estate.row_counts(), ["owner", "table"])
    return found.join(concerned, "column").groupBy("message").agg(F.sum("num_rows").alias("num_rows"))


@query(
    "A17",
    "SELECT 'naming_inconsistency' AS kind, m AS message, (SELECT count(*) FROM events) * 2 + "
    "(SELECT count(*) FROM orders) * 2 + (SELECT count(*) FROM conversations) AS num_rows FROM (VALUES "
    "('Both _DT and _DATE are in use: CREATED_DT beside LOG_DATE.'), "
    "('Both _NO and _NUM are in use: RUN_NO beside AUDIT_NUM.')) v(m)",
)
def naming_inconsistencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.applications(spark, sf_dir)
    rows = estate.row_counts().agg(F.sum("num_rows").alias("n")).scalar()
    found = findings.naming_inconsistencies(estate.columns())
    return found.select("kind", "message", rows.alias("num_rows"))


_BARE = (
    f"WITH {_CATALOG}, bare AS (SELECT owner, table_name, count(*) AS total, "
    "count(*) FILTER (trim(coalesce(c.comment, '')) = '') AS uncommented, "
    "string_agg(CASE WHEN trim(coalesce(c.comment, '')) = '' THEN column_name END, ', ' ORDER BY ordinal) AS columns "
    "FROM catalog LEFT JOIN column_comments c USING (table_name, column_name) GROUP BY ALL) "
)


@query(
    "A18",
    _BARE + "SELECT f.*, num_rows FROM (SELECT 'missing_table_comment' AS kind, owner, table_name AS \"table\", '' AS columns, "
    "table_name || ' has no comment.' AS message FROM bare "
    "WHERE table_name NOT IN (SELECT table_name FROM table_comments) UNION ALL "
    "SELECT 'missing_column_comment', owner, table_name, columns, uncommented || ' of ' || total || ' columns of ' "
    "|| table_name || ' have no comment.' FROM bare WHERE uncommented > 0) f JOIN counts ON table_name = \"table\"",
)
def missing_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.given(spark, sf_dir)
    found = findings.missing_comments(estate.tables(), estate.columns()).join(estate.row_counts(), ["owner", "table"])
    return found.select("kind", "owner", "table", F.array_join("columns", ", ").alias("columns"), "message", "num_rows")


def _loose_estate(spark: SparkSession, sf_dir: str) -> catalog.Estate:
    """Labels against embeddings: a reference that half of the rows break, by a low threshold."""
    embeddings, region = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "region")
    return catalog.Estate(spark, {
        ("APP", "vectors"): given_tables.Source(
            embeddings.select("vec_id", F.col("label").alias("area_key")), primary_key=("vec_id",)
        ),
        ("APP", "area"): given_tables.Source(region.select(F.col("r_regionkey").alias("area_key")), primary_key=("area_key",)),
    })


_ORPHANS = "(SELECT count(*) FROM embeddings WHERE label NOT IN (SELECT r_regionkey FROM region))"


@query(
    "J2 A19",
    f"SELECT 'orphan_rows' AS kind, 'warning' AS severity, 'vectors(area_key): ' || {_ORPHANS} || ' row(s) without a "
    f"match in area(area_key).' AS message, CAST({_ORPHANS} AS VARCHAR) AS orphan_rows UNION ALL "
    "SELECT 'undeclared_fk_candidate', 'notice', 'vectors(area_key) probably refers to area(area_key) (medium confidence).', NULL",
)
def relationship_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a threshold of 0.3 a half-broken reference is reported together with its orphans."""
    loose = settled(fk_discovery.discover(_loose_estate(spark, sf_dir), threshold=0.3))
    found = findings.relationship_findings(loose)
    return found.select("kind", "severity", "message", F.col("details")["orphan_rows"].alias("orphan_rows"))


_N_BARE_TABLES = "(SELECT count(*) FROM bare WHERE table_name NOT IN (SELECT table_name FROM table_comments))"


@query(
    "A19",
    _BARE + "SELECT 'undeclared_fk_candidate' AS kind, CAST(10 AS BIGINT) AS findings UNION ALL "
    f"SELECT 'missing_table_comment', {_N_BARE_TABLES} UNION ALL "
    "SELECT 'missing_column_comment', (SELECT count(*) FROM bare WHERE uncommented > 0)",
)
def findings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the whole scan, discovery included."""
    return findings.by_kind(_all_findings(given_tables.given(spark, sf_dir), None))


def _all_findings(estate: catalog.Estate, relationships: DataFrame | None) -> DataFrame:
    found = relationships if relationships is not None else settled(fk_discovery.discover(estate))
    return findings.all_findings(
        findings.relationship_findings(found), findings.type_inconsistencies(estate.columns()),
        findings.naming_inconsistencies(estate.columns()),
        findings.missing_comments(estate.tables(), estate.columns()),
    )


@query(
    "A25",
    # four references, of which none is broken; one mixed type; three tables without any comment
    "SELECT CAST(0 AS BIGINT) AS declared, CAST(4 AS BIGINT) AS inferred, CAST(3 AS BIGINT) AS tables, "
    "CAST(4 + 1 + 3 + 3 AS BIGINT) AS findings",
)
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.staff(spark, sf_dir)
    found = settled(fk_discovery.discover(estate))
    return findings.report_counters(estate.tables(), found, _all_findings(estate, found))


# ------------------------------------------------------------------ log tables

_APP_COLUMNS = {
    "audit_trail": "audit_num:N event_time:T action:V changed_by:N details:V",
    "error_log": "error_id:N log_time:T severity:V error_code:N module:N message:V",
    "job_run_log": "run_no:N job_name:V started_at:T status:V",
    "remarks": "conv_id:N turn:N remark:W log_date:N",
    "transactions": "txn_id:N customer_id:N amount:N created_dt:T details:V",
}
_APP_KEYS = {"audit_num", "error_id", "run_no", "conv_id", "turn", "txn_id"}
_APP_VALUES = ", ".join(
    f"('{t}', {i}, '{c.split(':')[0]}', '{c.split(':')[1]}', {str(c.split(':')[0] in _APP_KEYS).upper()})"
    for t, cols in _APP_COLUMNS.items() for i, c in enumerate(cols.split(), start=1)
)


def _words(words: list[str] | tuple[str, ...]) -> str:
    return f"regexp_matches(upper(name), '(^|_)({'|'.join(words)})(_|$)')"


_ROLE_SQL = f"""
    app AS (SELECT * FROM (VALUES {_APP_VALUES}) v(table_name, ordinal, name, type, in_key)),
    roles AS (
        SELECT *, CASE
            WHEN type = 'T' AND ({_words(logroles.TIME_WORDS)} OR regexp_matches(upper(name), '_(AT|TS)$')) THEN 'event_time'
            WHEN type = 'N' AND {_words(logroles.CODE_WORDS)} THEN 'code'
            WHEN {_words(logroles.SEVERITY_WORDS)} THEN 'severity'
            WHEN {_words(logroles.ACTOR_WORDS)} OR upper(name) LIKE '%\\_BY' ESCAPE '\\' THEN 'actor'
            WHEN {_words(logroles.SOURCE_WORDS)} THEN 'source'
            WHEN {_words(logroles.MESSAGE_WORDS)} THEN 'message'
            WHEN type = 'W' AND (SELECT max(length(text)) FROM conversations) >= 400 THEN 'message'
            WHEN NOT in_key AND regexp_matches(upper(name), '_(ID|NO|NUM)$') THEN 'business_ref'
            WHEN type = 'T' THEN 'event_time' END AS role
        FROM app
    )
"""


@query("C1 C2 F8", f"WITH {_ROLE_SQL} SELECT table_name AS \"table\", name AS \"column\", role FROM roles")
def log_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log roles of the application tables; the wide-text rule uses measured lengths."""
    estate = given_tables.applications(spark, sf_dir)
    columns = given_tables.with_measured_lengths(estate.columns(), estate)
    return logroles.column_roles(columns, estate.constraints()).select("table", "column", "role")


@query(
    "C3 C4",
    f"WITH {_ROLE_SQL}, facts AS (SELECT table_name, bool_or(role = 'event_time') AS t, bool_or(role = 'message') AS m, "
    "bool_or(role = 'severity') AS sv, bool_or(role = 'source') AS so, bool_or(role = 'business_ref') AS b, "
    "bool_or(type = 'N' AND name = 'amount') AS money, string_agg(CASE WHEN role IS NOT NULL THEN name || ':' || role END, ' ' "
    "ORDER BY ordinal) AS columns FROM roles GROUP BY 1), named AS (SELECT *, regexp_matches(upper(table_name), "
    f"'(^|_)({'|'.join(logroles.LOG_NAMES)})(_|$)') AS loggy FROM facts) "
    "SELECT table_name AS \"table\", CASE table_name WHEN 'error_log' THEN 'error' WHEN 'audit_trail' THEN 'audit' "
    "WHEN 'job_run_log' THEN 'job' ELSE 'generic' END AS kind, CASE WHEN loggy AND t AND m THEN 'high' "
    "WHEN (t AND m) OR (loggy AND (t OR m)) THEN 'medium' ELSE 'low' END AS confidence, columns FROM named "
    "WHERE ((t AND m) OR (loggy AND t::INT + m::INT + sv::INT + so::INT >= 3)) AND NOT (NOT loggy AND money AND b)",
)
def log_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.applications(spark, sf_dir)
    columns = given_tables.with_measured_lengths(estate.columns(), estate)
    found = logroles.log_tables(columns, estate.constraints())
    roles = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["column"], c["role"])), " ")
    return found.select("table", "kind", "confidence", roles.alias("columns"))


@query(
    "C5",
    "SELECT 'error_log' AS \"table\", 'error' AS kind, 'the name error_log is that of a log; log_time is its timestamp; message is its words of the entry; "
    "severity is its how bad; module is its where from; error_code is its error number' AS evidence, count(*) AS num_rows FROM events",
)
def default_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log an analyst is shown first, with its size."""
    estate = given_tables.applications(spark, sf_dir)
    columns = given_tables.with_measured_lengths(estate.columns(), estate)
    chosen = logroles.choose_log(logroles.log_tables(columns, estate.constraints()))
    return chosen.join(estate.row_counts(), ["owner", "table"]).select(
        "table", "kind", F.array_join("evidence", "; ").alias("evidence"), "num_rows"
    )


# ------------------------------------------------------------------ keys, meanings, summaries

_EDGES_SQL = ", ".join(
    f"('{c}', '{col}', '{p}', '{KEYS[p][0]}')" for c, col, p in [*TRUTH, ("events", "user_id", "events"), ("conversations", "conv_id", "events")]
)
_KEYS_SQL = ", ".join(f"('{t}', '{c}')" for t, cols in KEYS.items() for c in cols)
_KEYED = f"""
    edges AS (SELECT * FROM (VALUES {_EDGES_SQL}) v(table_name, column_name, parent, parent_column)),
    pk AS (SELECT * FROM (VALUES {_KEYS_SQL}) v(table_name, column_name)),
    keyed AS (
        SELECT c.*, CASE WHEN pk.table_name IS NOT NULL AND e.parent IS NOT NULL THEN 'primary_and_foreign_key'
                         WHEN pk.table_name IS NOT NULL THEN 'primary_key'
                         WHEN e.parent IS NOT NULL THEN 'foreign_key' ELSE 'none' END AS key_role,
               e.parent || '.' || e.parent_column || ' (inferred)' AS "references"
        FROM catalog c LEFT JOIN pk USING (table_name, column_name) LEFT JOIN edges e USING (table_name, column_name)
    )
"""


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[catalog.Estate, DataFrame, DataFrame]:
    estate = given_tables.given(spark, sf_dir)
    relationships = settled(fk_discovery.discover(estate))
    return estate, relationships, meaning.key_roles(estate.columns(), estate.constraints(), relationships)


@query(
    "J13",
    f"WITH {_CATALOG}, {_KEYED} SELECT owner, table_name AS \"table\", column_name AS \"column\", key_role, \"references\" FROM keyed",
)
def column_key_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key role and reference of every column, from the discovered relationships."""
    return _keyed(spark, sf_dir)[2].select("owner", "table", "column", "key_role", "references")


_FULL = "CASE " + " ".join(
    f"WHEN {{0}} IN ({', '.join(repr(t) for t in names)}) THEN '{owner}.' || {{0}}" for owner, names in OWNERS.items()
) + " END"


@query(
    "J14",
    f"WITH edges AS (SELECT * FROM (VALUES {_EDGES_SQL}) v(child, column_name, parent, parent_column)), "
    f"o AS (SELECT child AS t, string_agg({_FULL.format('parent')}, ', ' ORDER BY {_FULL.format('parent')}) AS outbound FROM edges GROUP BY 1), "
    f"i AS (SELECT parent AS t, string_agg({_FULL.format('child')}, ', ' ORDER BY {_FULL.format('child')}) AS inbound FROM edges GROUP BY 1) "
    "SELECT t AS \"table\", coalesce(outbound, '') AS outbound, coalesce(inbound, '') AS inbound FROM o FULL JOIN i USING (t)",
)
def relationship_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = meaning.relationship_index(settled(fk_discovery.discover(given_tables.given(spark, sf_dir))))
    return found.select("table", *[F.array_join(c, ", ").alias(c) for c in ("outbound", "inbound")])


@query("C8")
def column_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be shown of every column: structure, keys, measures, patterns and masked samples."""
    estate, _, keyed = _keyed(spark, sf_dir)
    summary = meaning.column_summaries(keyed, profile_estate(estate))
    lists = {c: F.array_join(c, " | ") for c in ("value_patterns", "masked_samples")}
    return summary.withColumns(lists).drop("comment")


_WORD_RULES = " ".join(
    f"WHEN regexp_matches(upper(column_name), '(^|_)({group.replace(' ', '|')})(_|$)') THEN '{label}'"
    for group, label, _ in meaning.MEANINGS
)
_GRADES = " ".join(f"WHEN '{label}' THEN '{grade}'" for _, label, grade in meaning.MEANINGS)


@query(
    "C6",
    f"WITH {_CATALOG}, {_KEYED}, r AS (SELECT k.*, trim(c.comment) AS comment, CASE {_WORD_RULES} END AS label, "
    "regexp_replace(replace(lower(table_name), '_', ' '), 's$', '') AS one FROM keyed k "
    "LEFT JOIN column_comments c USING (table_name, column_name)) "
    "SELECT owner, table_name AS \"table\", column_name AS \"column\", CASE WHEN comment <> '' THEN comment "
    "WHEN key_role LIKE 'primary%' THEN 'Primary key of a ' || one WHEN key_role = 'foreign_key' THEN 'Foreign key to ' || "
    "replace(\"references\", ' (inferred)', '') || ' (found by its values)' WHEN label IS NOT NULL THEN 'Probably ' || label "
    "WHEN regexp_matches(upper(column_name), '_(ID|KEY|NO|NUM)$') THEN 'Probably a number that identifies something' "
    "ELSE 'Unclear from structure alone' END AS meaning, CASE WHEN comment <> '' OR key_role LIKE 'primary%' THEN 'high' "
    f"WHEN key_role = 'foreign_key' THEN 'medium' WHEN label IS NOT NULL THEN CASE label {_GRADES} END ELSE 'low' END AS confidence FROM r",
)
def column_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = meaning.column_meanings(meaning.column_summaries(_keyed(spark, sf_dir)[2]))
    return found.select("owner", "table", "column", "meaning", "confidence")


@query(
    "C7",
    f"WITH {_CATALOG}, {_KEYED}, s AS (SELECT owner, table_name, count(*) AS n, count(*) FILTER (key_role = 'foreign_key') AS fk, "
    "bool_or(key_role = 'primary_key') AS has_pk, regexp_replace(replace(lower(table_name), '_', ' '), 's$', '') AS one "
    "FROM keyed GROUP BY ALL), i AS (SELECT parent AS table_name, count(*) AS n_in FROM edges GROUP BY 1), "
    "o AS (SELECT table_name, string_agg(DISTINCT parent, ', ' ORDER BY parent) AS targets FROM edges GROUP BY 1) "
    "SELECT owner, table_name AS \"table\", CASE WHEN c.comment IS NOT NULL THEN c.comment WHEN fk >= 2 AND fk >= n // 2 THEN "
    "'Seems to tie together ' || targets WHEN n_in >= 1 THEN 'Seems to hold the ' || one || ' records that "
    "others point at' WHEN n <= 3 AND has_pk THEN 'Seems to list the few codes of ' || one ELSE 'Its name suggests ' "
    "|| one || ' records' END AS purpose, CASE WHEN c.comment IS NOT NULL THEN 'high' WHEN (fk >= 2 AND fk >= n // 2) "
    "OR n_in >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM s LEFT JOIN i USING (table_name) LEFT JOIN o USING (table_name) "
    "LEFT JOIN table_comments c USING (table_name)",
)
def table_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate, relationships, keyed = _keyed(spark, sf_dir)
    found = meaning.table_purposes(estate.tables(), keyed, relationships)
    return found.select("owner", "table", "purpose", "confidence")


@query(
    "S11",
    f"WITH {_CATALOG}, cc AS (SELECT table_name, string_agg(column_name || '=' || comment, '; ' ORDER BY column_name) AS column_comments "
    "FROM column_comments WHERE trim(comment) <> '' GROUP BY 1) SELECT t.table_name AS \"table\", "
    "CASE WHEN trim(c.comment) <> '' THEN trim(c.comment) END AS comment, coalesce(column_comments, '') AS column_comments, "
    "CAST(list_count(list_filter([" + ", ".join(f"'{c}'" for c, *_ in TRUTH) + "], lambda x: x = t.table_name)) AS INTEGER) AS foreign_keys, num_rows "
    "FROM counts t LEFT JOIN table_comments c USING (table_name) LEFT JOIN cc USING (table_name)",
)
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is documented before the docs are stripped: comments and declared references."""
    estate = given_tables.given(spark, sf_dir)
    declared = catalog.resolve_constraints(*_dictionary(spark))
    truth = catalog.ground_truth(estate.tables(), estate.columns(), declared)
    pairs = F.array_sort(F.transform(F.map_entries("column_comments"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return truth.join(estate.row_counts(), ["owner", "table"]).select(
        "table", "comment", F.coalesce(F.array_join(pairs, "; "), F.lit("")).alias("column_comments"),
        F.coalesce(F.size("foreign_keys"), F.lit(0)).alias("foreign_keys"), "num_rows",
    )


@query(
    "G6",
    f"WITH {_CATALOG} SELECT owner, table_name AS \"table\", column_name AS \"column\", num_rows FROM catalog "
    "JOIN counts USING (table_name) WHERE upper(column_name) IN ('DOC_ID', 'TEXT', 'TURN')",
)
def where_columns_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.given(spark, sf_dir)
    found = catalog.columns_named(estate.columns(), ["doc_id", "text", "turn"])
    return found.join(estate.row_counts(), ["owner", "table"]).select("owner", "table", "column", "num_rows")
