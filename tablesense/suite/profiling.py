"""Profiling and privacy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesense.functions.privacy import mask_value, redact_text, structural_pattern
from tablesense.operators import profile
from tablesense.plans.table_profile import profile_estate
from tablesense.suite import estate as given_tables
from tablesense.suite.estate import OWNERS, table
from tablesense.suite.registry import query

# What is measured, by table: text columns compare in full, numbers and times without lengths,
# because their text form differs between engines.
_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount "
                "l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "conversations": "conv_id turn role",
    "documents": "doc_id lang source n_chars", "labels": "doc_id quality toxic",
    "pages": "page_id url", "benchmark": "item_id", "embeddings": "vec_id label",
}
_UNTEXTED = {
    "c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "o_orderdate", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "ts", "value",
}
_OWNER_OF = {name: owner for owner, names in OWNERS.items() for name in names}


def _measure_sql(name: str, column: str) -> str:
    text = "NULL" if column in _UNTEXTED else f"length(CAST({column} AS VARCHAR))"
    return (
        f"SELECT '{_OWNER_OF[name]}' AS owner, '{name}' AS \"table\", '{column}' AS \"column\", "
        f"count(*) AS total_rows, count(*) - count({column}) AS null_count, "
        f"count(DISTINCT {column}) AS distinct_count, CAST(min({text}) AS INTEGER) AS min_length, "
        f"CAST(max({text}) AS INTEGER) AS max_length FROM {name}"
    )


_PROFILE_SQL = (
    "SELECT *, CASE WHEN total_rows = 0 THEN 0.0 ELSE round(null_count / CAST(total_rows AS DOUBLE), 4) END "
    "AS null_fraction, distinct_count > 0 AND distinct_count <= 25 AND distinct_count < greatest(total_rows, 1) "
    "AS is_low_cardinality FROM ("
    + " UNION ALL ".join(_measure_sql(n, c) for n, cols in _COLUMNS.items() for c in cols.split())
    + ")"
)


@query("A1 A2 A3 A4 P6", _PROFILE_SQL)
def estate_column_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar column of every given table."""
    measured = profile_estate(given_tables.given(spark, sf_dir), samples=False)
    untexted = F.col("column").isin(*_UNTEXTED)
    return measured.withColumns(
        {c: F.when(~untexted, F.col(c)) for c in ("min_length", "max_length")}
    )


# ------------------------------------------------------------------ shapes and masks

# The SQL folds runs by listing what can repeat: the classes, and every separator one by one.
_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _pattern_sql(col: str, separators: str) -> str:
    v = _strip_sql(col)
    shape = rf"regexp_replace(regexp_replace({v}, '\p{{L}}', 'A', 'g'), '\p{{Nd}}', '9', 'g')"
    single = "|".join(
        ("\\" + c if c in r"\.+*?()|[]{}^$-/" else "''" if c == "'" else c) + "+" for c in separators
    )
    pieces = f"regexp_extract_all({shape}, 'A+|9+|{single}|(?s:.)')"
    fold = (
        f"list_transform({pieces}, lambda p: CASE WHEN length(p) >= 5 "
        "THEN p[1] || '{' || CAST(length(p) AS VARCHAR) || '}' ELSE p END)"
    )
    return (
        f"CASE WHEN {v} = '' THEN 'empty' "
        rf"WHEN regexp_matches({v}, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' "
        f"WHEN regexp_matches({v}, '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$') THEN 'uuid' "
        rf"WHEN regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}([ T]\d{{2}}:\d{{2}}(:\d{{2}})?)?$') THEN 'date' "
        f"ELSE array_to_string({fold}, '') END"
    )


def _mask_sql(col: str) -> str:
    v = _strip_sql(col)
    local, domain = f"split_part({v}, '@', 1)", f"split_part({v}, '@', 2)"
    label, host = rf"regexp_extract({domain}, '([^.]*)$', 1)", rf"regexp_extract({domain}, '^(.*)\.[^.]*$', 1)"

    def edge(part: str) -> str:
        return f"CASE length({part}) WHEN 0 THEN '' WHEN 1 THEN '*' ELSE {part}[1] || '***' END"

    return (
        rf"CASE WHEN regexp_matches({v}, '^[^@\s]+@[^@\s]+\.[^@\s]+$') "
        f"THEN {edge(local)} || '@' || {edge(host)} || '.' || {label} "
        f"WHEN length({v}) <= 2 THEN repeat('*', length({v})) "
        f"ELSE {v}[1] || repeat('*', length({v}) - 2) || {v}[-1] END"
    )


# Every character that is neither letter nor digit nor line break in the given texts.
_SEPARATORS = " .,;:!?-_/\\@#$%&*+=<>()[]{}|'\"~^`\t\r§°—–“”‘’…"


@query(
    "F1",
    f"SELECT doc_id, length(p) AS pattern_length, md5(p) AS pattern_md5 "
    f"FROM (SELECT doc_id, {_pattern_sql('text', _SEPARATORS)} AS p FROM documents)",
)
def document_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of every whole document text."""
    shaped = table(spark, sf_dir, "documents").select("doc_id", structural_pattern(F.col("text")).alias("p"))
    return shaped.select(
        "doc_id", F.length("p").cast("bigint").alias("pattern_length"), F.md5("p").alias("pattern_md5")
    )


_CONTACTS_SQL = (
    "SELECT c_custkey, c_name AS value FROM customer UNION ALL "
    "SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' FROM customer "
    "UNION ALL SELECT c_custkey, ' ' || left(c_mktsegment, CAST(c_custkey % 4 AS INTEGER)) FROM customer "
    "UNION ALL SELECT c_custkey, '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') FROM customer"
)


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, addresses made of them, short texts and dates, from the customer table."""
    customer = table(spark, sf_dir, "customer")
    address = F.concat(
        F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")
    )
    short = F.concat(F.lit(" "), F.left("c_mktsegment", (F.col("c_custkey") % 4).cast("int")))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))
    return customer.select(
        "c_custkey", F.explode(F.array(F.col("c_name"), address, short, day)).alias("value")
    )


@query(
    "F1 F2",
    f"SELECT c_custkey, {_pattern_sql('value', '#.@- ')} AS pattern, {_mask_sql('value')} AS masked "
    f"FROM ({_CONTACTS_SQL})",
)
def contact_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return _contacts(spark, sf_dir).select(
        "c_custkey", structural_pattern(value).alias("pattern"), mask_value(value).alias("masked")
    )


# Every text column but those that count as large objects.
_TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "supplier": ["s_name"], "lineitem": ["l_returnflag", "l_linestatus"],
    "customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderpriority", "o_orderstatus"], "events": ["props", "event_type"],
    "documents": ["source", "lang"], "pages": ["url"], "conversations": ["role"],
}
_VALUES_SQL = " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS \"column\", {c} AS value FROM {t}" for t, cols in _TEXT_COLUMNS.items() for c in cols
)


def _text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.estate_value_counts(
        [(table(spark, sf_dir, t), {c: f"{t}.{c}" for c in cols}) for t, cols in _TEXT_COLUMNS.items()]
    )


@query(
    "A5 W2",
    f"SELECT \"column\", pattern, n_rows, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY \"column\" ORDER BY n_rows DESC, pattern) AS place FROM (SELECT \"column\", pattern, "
    f"count(*) AS n_rows FROM (SELECT \"column\", {_pattern_sql('value', _SEPARATORS)} AS pattern "
    f"FROM ({_VALUES_SQL})) GROUP BY ALL)) WHERE place <= 4",
)
def pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_patterns(_text_counts(spark, sf_dir))


@query(
    "A6 W2",
    f"SELECT \"column\", masked, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY \"column\" ORDER BY first, masked) AS place FROM (SELECT \"column\", masked, "
    f"min(value) AS first FROM (SELECT \"column\", value, {_mask_sql('value')} AS masked FROM ({_VALUES_SQL})) "
    f"WHERE masked <> '' GROUP BY ALL)) WHERE place <= 3",
)
def masked_sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.masked_samples(_text_counts(spark, sf_dir)).select("column", "masked", "place")


_LOCAL, _HOST, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9.-]", "[A-Za-z]{2,}"


def _redact_sql(col: str) -> str:
    out = f"coalesce({col}, '')"
    for pattern, replacement in (
        (rf"({_LOCAL}){_LOCAL}+@({_HOST}){_HOST}+\.({_LABEL})", r"\1***@\2***.\3"),
        (rf"({_LOCAL}){_LOCAL}+@{_HOST}\.({_LABEL})", r"\1***@*.\2"),
        (rf"{_LOCAL}@({_HOST}){_HOST}+\.({_LABEL})", r"*@\1***.\2"),
        (rf"{_LOCAL}@{_HOST}\.({_LABEL})", r"*@*.\1"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return rf"regexp_replace({out}, '\b\d[\d -]{{5,}}\d\b', '<number>', 'g')"


@query(
    "F4 F5",
    f"SELECT doc_id, md5(r) AS redacted_md5, r <> text AS changed FROM "
    f"(SELECT doc_id, text, {_redact_sql('text')} AS r FROM documents)",
)
def document_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with addresses masked and long numbers replaced; every other column as it was."""
    redacted = table(spark, sf_dir, "documents").withColumn("redacted", redact_text(F.col("text")))
    return redacted.select(
        "doc_id", F.md5("redacted").alias("redacted_md5"), (F.col("redacted") != F.col("text")).alias("changed")
    )
