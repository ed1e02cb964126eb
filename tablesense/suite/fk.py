"""Foreign-key queries: overlap, orphans, candidates and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablesense.operators import candidates as rules, findings
from tablesense.operators.inclusion import inclusion, orphan_rows, overlap
from tablesense.plans import fk_discovery as discovery
from tablesense.sources.catalog import Estate
from tablesense.sources.tables import local_rows, settled
from tablesense.suite import estate as given_tables
from tablesense.suite.estate import KEYS, OWNERS, table
from tablesense.suite.registry import query


# ------------------------------------------------------------------ SQL building blocks


def _overlap_sql(child: str, cols: list[str], parent: str, keys: list[str]) -> str:
    """distinct_total, matched, overlap and orphan_rows of one pair; tables may be subqueries."""
    child_cols = ", ".join(f"CAST({c} AS VARCHAR) AS k{i}" for i, c in enumerate(cols))
    parent_cols = ", ".join(f"CAST({c} AS VARCHAR) AS k{i}" for i, c in enumerate(keys))
    names = ", ".join(f"k{i}" for i in range(len(cols)))
    full = " AND ".join(f"k{i} IS NOT NULL" for i in range(len(cols)))
    same = " AND ".join(f"p.k{i} = c.k{i}" for i in range(len(cols)))
    exists = f"EXISTS (SELECT 1 FROM (SELECT {parent_cols} FROM {parent}) p WHERE {same})"
    child_rows = f"(SELECT * FROM (SELECT {child_cols} FROM {child}) WHERE {full})"
    return (
        f"SELECT distinct_total, matched, matched / CAST(distinct_total AS DOUBLE) AS overlap, orphan_rows FROM ("
        f"SELECT (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {child_rows})) AS distinct_total, "
        f"(SELECT count(*) FROM (SELECT DISTINCT {names} FROM {child_rows}) c WHERE {exists}) AS matched, "
        f"(SELECT count(*) FROM {child_rows} c WHERE NOT {exists}) AS orphan_rows) WHERE distinct_total > 0"
    )


def _pairs_sql(pairs: list[tuple]) -> str:
    """One row per (child table, child column, parent table, parent key[, child SQL, parent SQL])."""
    parts = []
    for child, col, parent, key, *sources in pairs:
        child_sql, parent_sql = sources or (child, parent)
        cols, keys = col.split("+"), key.split("+")
        parts.append(
            f"SELECT '{child}' AS child, '{col}' AS child_column, '{parent}' AS parent, "
            f"'{key}' AS parent_key, m.* FROM ({_overlap_sql(child_sql, cols, parent_sql, keys)}) m"
        )
    return " UNION ALL ".join(parts)


def _flat(measured: DataFrame) -> DataFrame:
    return measured.select(
        F.col("table").alias("child"), F.array_join("columns", "+").alias("child_column"),
        F.col("parent_table").alias("parent"), F.array_join("parent_columns", "+").alias("parent_key"),
        "distinct_total", "matched", "overlap", "orphan_rows",
    )


def _frames(estate: Estate) -> dict:
    return {k: s.rows for k, s in estate.sources.items()}


# ------------------------------------------------------------------ single pairs


@query("S1 J1 J2 F3", _overlap_sql("lineitem", ["l_partkey"], "part", ["p_partkey"]))
def value_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap(table(spark, sf_dir, "lineitem"), ["l_partkey"], table(spark, sf_dir, "part"), ["p_partkey"])


@query("J1 J2 M5", _overlap_sql("embeddings", ["label"], "region", ["r_regionkey"]))
def value_overlap_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap(
        table(spark, sf_dir, "embeddings"), ["label"], table(spark, sf_dir, "region"), ["r_regionkey"]
    )


@query(
    "F3 J1 M1",
    _overlap_sql("(SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders)", ["k"], "customer", ["c_custkey"]),
)
def value_overlap_text_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text child and a floating-point copy of a numeric key meet as text."""
    child = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    parent = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("c_custkey"))
    return overlap(child, ["k"], parent, ["c_custkey"])


@query(
    "J2",
    "SELECT vec_id, label FROM embeddings e WHERE label IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM region r WHERE r.r_regionkey = e.label)",
)
def orphan_row_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return orphan_rows(child, ["label"], table(spark, sf_dir, "region"), ["r_regionkey"])


_NEXT_TURN = "(SELECT conv_id, turn + 1 AS next_turn FROM conversations)"


@query("J3 J4 M4", _overlap_sql(_NEXT_TURN, ["conv_id", "next_turn"], "conversations", ["conv_id", "turn"]))
def composite_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does every turn have a following one? The last turn of each conversation has none."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    following = turns.select("conv_id", (F.col("turn") + 1).alias("next_turn"))
    return overlap(following, ["conv_id", "next_turn"], turns, ["conv_id", "turn"])


@query(
    "J4",
    f"SELECT conv_id, next_turn FROM {_NEXT_TURN} c WHERE NOT EXISTS (SELECT 1 FROM conversations p "
    "WHERE p.conv_id = c.conv_id AND p.turn = c.next_turn)",
)
def composite_orphan_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    following = turns.select("conv_id", (F.col("turn") + 1).alias("next_turn"))
    return orphan_rows(following, ["conv_id", "next_turn"], turns, ["conv_id", "turn"])


# ------------------------------------------------------------------ every pair of an estate

# every whole-number column of the given tables, keys among them
_INTEGERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
    "documents": ["doc_id", "n_chars"], "labels": ["doc_id", "quality", "toxic"], "embeddings": ["vec_id", "label"],
    "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
_OWNER_OF = {name: owner for owner, names in OWNERS.items() for name in names}
_SINGLE_KEYS = {name: key[0] for name, key in KEYS.items() if len(key) == 1}
_ALL_PAIRS = [
    (child, col, parent, key)
    for child, cols in _INTEGERS.items() for col in cols
    for parent, key in _SINGLE_KEYS.items() if parent != child
]


@query("J5", _pairs_sql(_ALL_PAIRS))
def inclusion_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole-number column, as the tables' schemas have them, against every key of another table, in one job."""
    frames = _frames(given_tables.given(spark, sf_dir))
    numbers = [(*where, f.name) for where, df in frames.items() for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    rows = [
        (owner, child, [col], _OWNER_OF[parent], parent, [key])
        for owner, child, col in numbers for parent, key in _SINGLE_KEYS.items() if parent != child
    ]
    candidates = local_rows(
        spark, rows, "owner string, table string, columns array<string>, parent_owner string, "
        "parent_table string, parent_columns array<string>",
    )
    return _flat(inclusion(frames, candidates))


# ------------------------------------------------------------------ candidates by rule, measured


def _measured(estate: Estate, found: DataFrame) -> DataFrame:
    return _flat(inclusion(_frames(estate), found))


@query("J6 J10", _pairs_sql([("labels", "doc_id", "documents", "doc_id")]))
def candidates_exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.given(spark, sf_dir)
    return _measured(estate, rules.exact_name(rules.CatalogFrames.of(estate)))


_SUFFIX_PAIRS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
_ID_KEYS = [(t, _SINGLE_KEYS[t]) for t in ("documents", "events", "pages", "benchmark", "embeddings")]
_ID_PAIRS = [
    (child, col, parent, key)
    for child, col in (("events", "user_id"), ("conversations", "conv_id"), ("labels", "doc_id"))
    for parent, key in _ID_KEYS
]


@query("J7 F6 F7", _pairs_sql(_SUFFIX_PAIRS + _ID_PAIRS))
def candidates_same_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.given(spark, sf_dir)
    return _measured(estate, rules.same_suffix(rules.CatalogFrames.of(estate)))


@query("J8", _pairs_sql([("ratings", "conv_id+turn", "turns", "conv_id+turn", "conversations", "conversations")]))
def candidates_composite_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.dialogues(spark, sf_dir)
    return _measured(estate, rules.composite_exact(rules.CatalogFrames.of(estate)))


_REPLIES = "(SELECT conv_id AS source_id, turn + 1 AS next_turn, turn AS source_turn FROM conversations)"


@query("J9", _pairs_sql([
    ("replies", f"source_id+{t}", "turns", "conv_id+turn", _REPLIES, "conversations")
    for t in ("next_turn", "source_turn")
]))
def candidates_composite_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.dialogues(spark, sf_dir)
    return _measured(estate, rules.composite_suffix(rules.CatalogFrames.of(estate)))


# ------------------------------------------------------------------ discovery


def _edges(found: DataFrame) -> DataFrame:
    return found.select(
        "rule", F.concat_ws(".", "owner", "table").alias("child"),
        F.array_join("columns", "+").alias("child_column"),
        F.concat_ws(".", "parent_owner", "parent_table").alias("parent"),
        F.array_join("parent_columns", "+").alias("parent_key"),
        "confidence", F.array_join("evidence", " ").alias("evidence"), "overlap", "orphan_rows", "cross_schema",
    )


def _discovery_sql(candidates: list[tuple], threshold: float = 0.85) -> str:
    """Best measured parent per child and rule; candidates carry their place in catalog order.

    (rule, child, child column, parent, parent key, place, evidence, is key pair, child SQL, parent SQL)
    """
    parts = []
    for rule, child, col, parent, key, place, evidence, key_pair, child_sql, parent_sql in candidates:
        cols, keys = col.split("+"), key.split("+")
        text = evidence.replace("'", "''")
        group = col if rule in ("exact", "suffix") else f"{parent}({key})"
        parts.append(
            f"SELECT '{rule}' AS rule, '{child}' AS child, '{col}' AS child_column, '{parent}' AS parent, "
            f"'{key}' AS parent_key, {place} AS place, '{text}' AS why, {str(key_pair).upper()} AS key_pair, "
            f"'{group}' AS grp, m.* FROM ({_overlap_sql(child_sql, cols, parent_sql, keys)}) m"
        )
    kind = "CASE WHEN rule IN ('exact', 'suffix') THEN 'values' ELSE 'value tuples' END"
    return f"""
        WITH measured AS ({' UNION ALL '.join(parts)}),
        best AS (
            SELECT * FROM measured WHERE overlap >= {threshold}
            QUALIFY row_number() OVER (PARTITION BY rule, child, grp ORDER BY overlap DESC, place) = 1
        ),
        kept AS (
            SELECT * FROM best a WHERE NOT (a.rule = 'exact' AND a.key_pair AND EXISTS (
                SELECT 1 FROM best b WHERE b.rule = 'exact' AND b.key_pair AND b.child = a.parent
                AND b.child_column = a.parent_key AND b.parent = a.child AND b.parent_key = a.child_column))
        )
        SELECT rule, child, child_column, parent, parent_key,
               CASE WHEN overlap >= 0.99 THEN 'high' ELSE 'medium' END AS confidence,
               why || ' ' || CAST(CAST(round_even(overlap * 100, 0) AS BIGINT) AS VARCHAR)
                   || '% of the distinct ' || {kind} || ' are in the key.' AS evidence,
               overlap, orphan_rows, split_part(child, '.', 1) <> split_part(parent, '.', 1) AS cross_schema
        FROM kept a
        WHERE rule <> 'suffix' OR NOT EXISTS (
            SELECT 1 FROM kept b WHERE b.rule = 'exact' AND b.child = a.child AND b.child_column = a.child_column)
    """


def _named(rule: str, child: str, col: str, parent: str, key: str, place: int, extra: str = "") -> tuple:
    owner = _OWNER_OF[child], _OWNER_OF[parent]
    cross = " (cross-schema)" if owner[0] != owner[1] else " (self-reference)" if child == parent else ""
    why = (
        f"Named like the key {parent}.{key}{cross}." if rule == "exact"
        else f"Ends in {col.rsplit('_', 1)[-1]} and has the type of {parent}.{key}{cross}."
    )
    child_full, parent_full = f"{owner[0]}.{child}", f"{owner[1]}.{parent}"
    return rule, child_full, col, parent_full, key, place, why + extra, False, child, parent


_CATALOG_PLACE = {
    name: i for i, name in enumerate(t for names in OWNERS.values() for t in sorted(names))
}
_GIVEN_CANDIDATES = [_named("exact", "labels", "doc_id", "documents", "doc_id", 0)] + [
    _named("suffix", c, col, p, key, _CATALOG_PLACE[p]) for c, col, p, key in _SUFFIX_PAIRS + _ID_PAIRS
]


@query("J5 J6 J7 J8 J9 J10 J12 W1 P7 F14 F15", _discovery_sql(_GIVEN_CANDIDATES))
def fk_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: declare nothing, rediscover the references between all given tables."""
    return _edges(discovery.discover(given_tables.given(spark, sf_dir)))


_STAFF = {
    "employees": "(SELECT s_suppkey AS employee_id, s_suppkey - s_suppkey % 3 AS manager_id, "
                 "s_nationkey AS department_id FROM supplier)",
    "departments": "(SELECT n_nationkey AS department_id FROM nation)",
    "contacts": "(SELECT c_custkey % 97 AS rep_id, c_nationkey AS department_id FROM customer)",
}


def _staff(rule: str, child: str, col: str, parent: str, key: str, place: int, why: str) -> tuple:
    full = {"employees": "HR.employees", "departments": "HR.departments", "contacts": "EXT.contacts"}
    return rule, full[child], col, full[parent], key, place, why, False, _STAFF[child], _STAFF[parent]


@query("J6 J7 J12", _discovery_sql([
    _staff("exact", "contacts", "department_id", "departments", "department_id", 0,
           "Named like the key departments.department_id (cross-schema). "
           "Its type VARCHAR2 is not the key's NUMBER."),
    _staff("exact", "employees", "department_id", "departments", "department_id", 0,
           "Named like the key departments.department_id."),
    _staff("suffix", "contacts", "rep_id", "departments", "department_id", 0,
           "Ends in id and has the type of departments.department_id (cross-schema)."),
    _staff("suffix", "contacts", "rep_id", "employees", "employee_id", 1,
           "Ends in id and has the type of employees.employee_id (cross-schema)."),
    _staff("suffix", "employees", "manager_id", "departments", "department_id", 0,
           "Ends in id and has the type of departments.department_id."),
    _staff("suffix", "employees", "manager_id", "employees", "employee_id", 1,
           "Ends in id and has the type of employees.employee_id (self-reference)."),
]))
def fk_discovery_across_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-reference, cross-schema references and a text column that refers to a number."""
    return _edges(discovery.discover(given_tables.staff(spark, sf_dir)))


@query("J3 J8 J9 W1", _discovery_sql([
    ("composite_exact", "APP.ratings", "conv_id+turn", "APP.turns", "conv_id+turn", 0,
     "Holds all of the key (conv_id, turn) of turns.", False, "conversations", "conversations"),
    *[("composite_suffix", "APP.replies", f"source_id+{t}", "APP.turns", "conv_id+turn", i,
       f"Matches the key of turns by suffix and type (source_id->conv_id, {t}->turn).",
       False, _REPLIES, "conversations") for i, t in enumerate(("next_turn", "source_turn"))],
]))
def fk_discovery_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(discovery.discover(given_tables.dialogues(spark, sf_dir)))


_RECEIPT = "(SELECT CAST(o_custkey AS VARCHAR) AS c_custkey FROM orders)"


@query("J11", _discovery_sql([
    ("exact", "SALES.customer", "c_custkey", "SALES.prospect", "c_custkey", 1,
     "Named like the key prospect.c_custkey.", True, "customer", "customer"),
    ("exact", "SALES.prospect", "c_custkey", "SALES.customer", "c_custkey", 0,
     "Named like the key customer.c_custkey.", True, "customer", "customer"),
    *[("exact", "SALES.receipt", "c_custkey", f"SALES.{p}", "c_custkey", i,
       f"Named like the key {p}.c_custkey. Its type VARCHAR2 is not the key's NUMBER.",
       False, _RECEIPT, "customer") for i, p in enumerate(("customer", "prospect"))],
]))
def fk_discovery_twin_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that merely share a key name and range do not refer to each other."""
    return _edges(discovery.discover(given_tables.twins(spark, sf_dir)))


@query(
    "P7",
    "SELECT 'events' AS child, 'user_id' AS child_column, 'staged_users' AS parent, FALSE AS measured, "
    "count(*) AS child_rows FROM events",
)
def known_empty_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate whose parent was measured as empty is dropped before any overlap is computed."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    staged = events.filter(F.col("user_id") < 0).select("user_id")
    sources = {
        ("APP", "events"): given_tables.Source(events, primary_key=("event_id",)),
        ("APP", "staged_users"): given_tables.Source(staged, primary_key=("user_id",)),
    }
    estate = Estate(spark, sources)
    counts = estate.row_counts()
    named = rules.exact_name(rules.CatalogFrames.of(estate))
    left = rules.without_known_empty(named, rules.measured_empty(counts), "parent_")
    kept = left.select("owner", "table", "columns", "parent_table", F.lit(True).alias("kept"))
    rows = counts.select("owner", "table", F.col("num_rows").alias("child_rows"))
    return (
        named.join(kept, ["owner", "table", "columns", "parent_table"], "left").join(rows, ["owner", "table"])
        .select(
            F.col("table").alias("child"), F.array_join("columns", "+").alias("child_column"),
            F.col("parent_table").alias("parent"), F.coalesce("kept", F.lit(False)).alias("measured"),
            "child_rows",
        )
    )


# ------------------------------------------------------------------ declared keys

_EMPLOYEES = "(SELECT s_suppkey AS employee_id, s_suppkey - s_suppkey % 3 AS manager_id, s_nationkey AS department_id FROM supplier)"
_CONTACTS = "(SELECT c_custkey % 97 AS rep_id, c_nationkey AS department_id FROM customer)"
_DEPARTMENTS = "(SELECT n_nationkey AS department_id FROM nation)"
_LINE_KEY = "l_orderkey AS order_number, l_linenumber AS line_number FROM lineitem"
_CLAIMS, _ORDER_LINES = f"(SELECT {_LINE_KEY} WHERE l_returnflag = 'R')", f"(SELECT {_LINE_KEY} WHERE l_quantity > 1)"
_STATED = [
    # child, columns, parent, key, declared, child rows, parent rows
    ("HR.employees", "department_id", "HR.departments", "department_id", True, _EMPLOYEES, _DEPARTMENTS),
    ("EXT.contacts", "rep_id", "HR.employees", "employee_id", True, _CONTACTS, _EMPLOYEES),
    ("EXT.claims", "order_number+line_number", "EXT.order_lines", "order_number+line_number", True, _CLAIMS, _ORDER_LINES),
    ("HR.employees", "manager_id", "HR.employees", "employee_id", False, _EMPLOYEES, _EMPLOYEES),
    ("EXT.contacts", "department_id", "HR.departments", "department_id", False, _CONTACTS, _DEPARTMENTS),
]
_STATED_SQL = " UNION ALL ".join(
    f"SELECT '{child}' AS child, '{cols}' AS columns, '{parent}' AS parent, {str(known).upper()} AS declared, overlap, orphan_rows "
    f"FROM ({_overlap_sql(child_sql, cols.split('+'), parent_sql, key.split('+'))})" + ("" if known else " WHERE overlap >= 0.85")
    for child, cols, parent, key, known, child_sql, parent_sql in _STATED
)


@query("J10 J13", _STATED_SQL)
def declared_and_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared references beside the found ones, all measured; columns of a declared one get no other."""
    found = discovery.relationships(given_tables.staff_with_declared_keys(spark, sf_dir))
    return found.select(
        F.concat_ws(".", "owner", "table").alias("child"), F.array_join("columns", "+").alias("columns"),
        F.concat_ws(".", "parent_owner", "parent_table").alias("parent"), "declared", "overlap", "orphan_rows",
    )


@query("A25 J10", f"SELECT count(*) FILTER (declared) AS declared, count(*) FILTER (NOT declared) AS inferred, CAST(5 AS BIGINT) AS tables, "
       f"count(*) FILTER (NOT declared) + count(*) FILTER (NOT declared AND orphan_rows > 0) AS findings FROM ({_STATED_SQL})")
def declared_report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a report over an estate with declared keys: found keys and their orphans are findings, declared ones are not."""
    estate = given_tables.staff_with_declared_keys(spark, sf_dir)
    found = settled(discovery.relationships(estate))
    return findings.report_counters(estate.tables(), found, findings.relationship_findings(found))
