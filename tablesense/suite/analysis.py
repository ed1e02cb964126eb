"""Fan-out, evaluation, dependency and small scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tablesense.functions.grading import count_or_zero
from tablesense.operators import deps, evaluate, fanout, meaning
from tablesense.plans import fk_discovery
from tablesense.sources.tables import capped, local_rows, settled
from tablesense.suite import estate as given_tables
from tablesense.suite.estate import COMMENTS, KEYS, OWNERS, TRUTH, table
from tablesense.suite.registry import query

_OWNER_OF = {name: owner for owner, names in OWNERS.items() for name in names}
_EDGE = (
    "owner string, table string, columns array<string>, parent_owner string, parent_table string, "
    "parent_columns array<string>"
)


def _truth(spark: SparkSession) -> DataFrame:
    rows = [(_OWNER_OF[c], c, [col], _OWNER_OF[p], p, [KEYS[p][0]]) for c, col, p in TRUTH]
    return local_rows(spark, rows, _EDGE)


# ------------------------------------------------------------------ fan-out

# What each kind of event asks, as query text.
_ASKED = {
    "view": "SELECT n.n_name, SUM(c.c_acctbal) FROM sales.nation n JOIN customer c ON 1=1 JOIN Supplier s ON 1=1",
    "click": "SELECT COUNT(*) FROM customer c JOIN orders o ON 1=1 JOIN lineitem l ON 1=1",
    "signup": "WITH a AS (SELECT SUM(x) FROM customer) SELECT * FROM a JOIN nation n ON 1=1 JOIN supplier s ON 1=1",
    "purchase": "SELECT c.c_name FROM nation n JOIN customer c ON 1=1 JOIN supplier s ON 1=1",
    "error": "SELECT AVG(l_quantity) FROM lineitem JOIN region ON 1=1",
}
_ASKED_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ASKED.items()) + " END"
_ASKED_TABLES = {
    "view": ("NATION", "CUSTOMER", "SUPPLIER"), "click": ("CUSTOMER", "ORDERS", "LINEITEM"),
    "signup": ("CUSTOMER", "A", "NATION", "SUPPLIER"), "purchase": ("NATION", "CUSTOMER", "SUPPLIER"),
    "error": ("LINEITEM", "REGION"),
}


def _query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in _ASKED.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query"), kinds[F.col("event_type")].alias("sql")
    )


@query(
    "G4",
    "SELECT event_id AS query, t AS \"table\" FROM events JOIN (VALUES "
    + ", ".join(f"('{k}', '{t}')" for k, tables in _ASKED_TABLES.items() for t in tables)
    + ") v(kind, t) ON kind = event_type",
)
def tables_in_query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.referenced_tables(_query_log(spark, sf_dir))


@query(
    "J18 G4",
    "SELECT event_id AS query, 'NATION' AS parent, 'CUSTOMER+SUPPLIER' AS children FROM events WHERE event_type = 'view'",
)
def fan_out_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregating queries that join two details of one parent; chains, plain lists and WITH are left alone."""
    used = deps.referenced_tables(deps.aggregating(_query_log(spark, sf_dir)))
    found = fanout.fan_out_parents(_truth(spark), used)
    return found.select("query", "parent", F.array_join("children", "+").alias("children"))


def _nation_details(spark: SparkSession, sf_dir: str) -> dict:
    return {
        "customer": (table(spark, sf_dir, "customer"), "c_nationkey"),
        "supplier": (table(spark, sf_dir, "supplier"), "s_nationkey"),
    }


@query(
    "J19",
    "WITH j AS (SELECT count(*) AS joined_rows FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey), "
    "c AS (SELECT count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_nationkey IN (SELECT n_nationkey FROM nation)), "
    "s AS (SELECT count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) AND s_nationkey IN (SELECT n_nationkey FROM nation)) "
    "SELECT 'customer' AS detail, joined_rows, c.n AS detail_rows, joined_rows / c.n::DOUBLE AS factor FROM j, c UNION ALL "
    "SELECT 'supplier', joined_rows, s.n, joined_rows / s.n::DOUBLE FROM j, s",
)
def fan_out_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the naive join repeats each detail row, without running that join."""
    return fanout.fan_out_factor(table(spark, sf_dir, "nation"), "n_nationkey", _nation_details(spark, sf_dir))


@query(
    "J19",
    "SELECT n_nationkey, n_name, n_customers, n_suppliers, round(customer_balance, 2) AS customer_balance, round(supplier_balance, 2) AS supplier_balance "
    "FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers, sum(c_acctbal) AS customer_balance FROM customer GROUP BY 1) ON c_nationkey = n_nationkey "
    "LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers, sum(s_acctbal) AS supplier_balance FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey",
)
def safe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers per nation, each aggregated before the join."""
    n = F.count(F.lit(1))
    details = {
        "customer": (*_nation_details(spark, sf_dir)["customer"], [n.alias("n_customers"), F.sum("c_acctbal").alias("customer_balance")]),
        "supplier": (*_nation_details(spark, sf_dir)["supplier"], [n.alias("n_suppliers"), F.sum("s_acctbal").alias("supplier_balance")]),
    }
    found = fanout.safe_rollup(table(spark, sf_dir, "nation"), "n_nationkey", details)
    money = {c: F.round(c, 2) for c in ("customer_balance", "supplier_balance")}
    return found.withColumns(money).drop("n_regionkey")


@query(
    "J19",
    "SELECT c_custkey, n_orders, round(spent, 2) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, "
    "sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def safe_rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")]
    details = {"orders": (table(spark, sf_dir, "orders"), "o_custkey", aggregates)}
    return fanout.safe_rollup(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", details)


# ------------------------------------------------------------------ evaluation


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(fk_discovery.discover(given_tables.given(spark, sf_dir)))


_SCORE = "8::BIGINT AS truth_total, 10::BIGINT AS found_total, 8::BIGINT AS matched, 1.0::DOUBLE AS recall, 0.8::DOUBLE AS precision"


@query("J16 A22", f"SELECT {_SCORE}")
def fk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declare nothing, rediscover: all eight true references, and two that only the id ranges suggest."""
    return evaluate.fk_score(_truth(spark), _found(spark, sf_dir))


@query("J16", f"SELECT {_SCORE}")
def fk_recall_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fk_score(_truth(spark), _found(spark, sf_dir), strict=True)


@query(
    "U2",
    "SELECT * FROM (VALUES " + ", ".join(f"('{c.upper()}', '{col.upper()}', '{p.upper()}')" for c, col, p in TRUTH)
    + ") v(child, cols, parent)",
)
def matched_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.matched_edges(_truth(spark), _found(spark, sf_dir))
    return found.select("child", F.array_join("cols", ",").alias("cols"), "parent")


@query("U3", "SELECT 'PAGES(PAGE_ID) -> DOCUMENTS' AS missed")
def missed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference nobody can find, because the data does not carry it, is reported as missed."""
    extra = local_rows(spark, [("CORPUS", "pages", ["page_id"], "CORPUS", "documents", ["doc_id"])], _EDGE)
    return evaluate.missed_edges(_truth(spark).unionByName(extra), _found(spark, sf_dir))


@query("J17 A23", "SELECT 4::BIGINT AS documented, 4::BIGINT AS recovered, 1.0::DOUBLE AS coverage")
def column_doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the columns with a comment, how many get a meaning once the comments are stripped."""
    estate = given_tables.given(spark, sf_dir)
    stripped = estate.columns().withColumn("comment", F.lit(None).cast("string"))
    keyed = meaning.key_roles(stripped, estate.constraints(), _found(spark, sf_dir))
    meanings = meaning.column_meanings(meaning.column_summaries(keyed))
    documented = estate.columns().filter(F.trim("comment") != "").select("table", "column")
    return evaluate.coverage(documented, meanings, ["table", "column"])


@query("J17 A23", f"SELECT {len([1 for c, _ in COMMENTS.values() if c])}::BIGINT AS documented, 2::BIGINT AS recovered, 1.0::DOUBLE AS coverage")
def table_doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    estate = given_tables.given(spark, sf_dir)
    found = _found(spark, sf_dir)
    keyed = meaning.key_roles(estate.columns(), estate.constraints(), found)
    stripped = estate.tables().withColumn("comment", F.lit(None).cast("string"))
    purposes = meaning.table_purposes(stripped, keyed, found)
    documented = estate.tables().filter(F.trim("comment") != "").select("table")
    return evaluate.coverage(documented, purposes, ["table"])


# ------------------------------------------------------------------ source texts


def _package_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines of orders as packages: every line declares a routine for its part, whose body updates its supplier.

    The routines are declared in the specification; the body of the package follows.
    """
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("routine")),
        "l_partkey",
    )
    kind = F.when(F.col("l_quantity") > 25, "FUNCTION").otherwise("PROCEDURE")
    header = F.concat(kind, F.lit(" "), F.lower("routine"))
    spec = F.concat(header, F.lit(";\n"))
    body = F.concat(header, F.lit(" IS BEGIN update supp_"), "l_suppkey", F.lit(" set part_"), "l_partkey", F.lit(" = 1; END;\n"))
    owner = F.lit("SALES").alias("owner")
    # Lines of an order are put in a fixed order by what they say.
    place = F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    texts = F.array(
        F.struct(F.lit("PACKAGE").alias("type"), place.alias("line"), spec.alias("text")),
        F.struct(F.lit("PACKAGE BODY").alias("type"), place.alias("line"), body.alias("text")),
    )
    written = lines.select(owner, F.concat(F.lit("PKG_"), "l_orderkey").alias("name"), F.inline(texts))
    start = table(spark, sf_dir, "orders").select(
        owner, F.concat(F.lit("PKG_"), "o_orderkey").alias("name"), F.lit("PACKAGE BODY").alias("type"),
        F.lit(-1).cast("bigint").alias("line"), F.lit("PACKAGE BODY\n").alias("text"),
    )
    return written.unionByName(start)


_LINES = (
    "SELECT 'PKG_' || l_orderkey AS name, upper(replace(p_name, ' ', '_')) AS routine, l_suppkey, l_partkey, "
    "CASE WHEN l_quantity > 25 THEN 'FUNCTION' ELSE 'PROCEDURE' END AS kind, "
    "l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS place FROM lineitem JOIN part ON p_partkey = l_partkey"
)


@query(
    "G1 S8",
    f"SELECT name, routine, (row_number() OVER (PARTITION BY name ORDER BY first))::INTEGER AS place, kind AS routine_kind FROM "
    f"(SELECT name, routine, min(place) AS first, arg_min(kind, place) AS kind FROM ({_LINES}) GROUP BY 1, 2)",
)
def declared_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every package declares, in order, overloads once."""
    found = deps.declared_routines_in_lines(_package_lines(spark, sf_dir))
    place = F.row_number().over(W.partitionBy("name").orderBy("position"))
    return found.select("name", "routine", place.alias("place"), "routine_kind")


_SUPPLIERS = "(SELECT 'supp_' || s_suppkey AS identifier FROM supplier)"


@query(
    "G2",
    f"SELECT DISTINCT name, routine, 'supp_' || l_suppkey AS identifier FROM ({_LINES}) WHERE 'supp_' || l_suppkey IN (SELECT identifier FROM {_SUPPLIERS})",
)
def routine_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which routine of which package touches which supplier."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supp_"), "s_suppkey").alias("identifier"))
    # line numbers are sparse here: a block is all lines of one line number
    return deps.routine_references_in_lines(_package_lines(spark, sf_dir), suppliers, lines_per_block=1000000000).select("name", "routine", "identifier")


@query(
    "G3",
    f"SELECT 'supp_' || l_suppkey AS identifier, count(DISTINCT name) AS n_units FROM ({_LINES}) GROUP BY 1 UNION ALL "
    "SELECT 'package', count(*) FROM orders",
)
def identifier_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packages against all suppliers at once: who uses what."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supp_"), "s_suppkey").alias("identifier"))
    extra = local_rows(spark, [("package",), ("nowhere",)], "identifier string")
    found = deps.usages_in_lines(_package_lines(spark, sf_dir), suppliers.unionByName(extra))
    return found.groupBy("identifier").agg(F.count(F.lit(1)).alias("n_units"))


_UNICODE_WORD = r"[\p{L}\p{N}\p{M}_]+"


@query(
    "G3",
    f"WITH b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{_UNICODE_WORD}'))) AS identifier FROM benchmark), "
    f"d AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_UNICODE_WORD}'))) AS identifier FROM documents) "
    "SELECT identifier, count(*) AS n_documents FROM d SEMI JOIN b USING (identifier) GROUP BY 1",
)
def benchmark_words_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark texts against every document: an inverted index and one join."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"))).alias("identifier"))
    documents = table(spark, sf_dir, "documents").select(
        F.lit("CORPUS").alias("owner"), F.col("doc_id").cast("string").alias("name"), F.lit("TEXT").alias("kind"), F.col("text").alias("source")
    )
    found = deps.usages(documents, words.distinct())
    return found.groupBy("identifier").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "G5",
    "SELECT event_id AS script, 'K' || json_extract_string(props, '$.k') AS name FROM events "
    "WHERE json_extract_string(props, '$.k')::INT >= 50",
)
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts made of events: half of the columns they name exist nowhere; package calls are no columns."""
    k = F.get_json_object("props", "$.k")
    code = F.concat(
        F.lit("-- e.hidden\nSELECT e.event_type, e.k"), k, F.lit(" FROM app.events e; pkg_"), "user_id", F.lit(" . run_it();")
    )
    events = table(spark, sf_dir, "events")
    scripts = events.select(F.col("event_id").alias("script"), code.alias("code"))
    names = given_tables.given(spark, sf_dir).columns().select(F.inline(F.array(
        *[F.struct(F.col(c).alias("name")) for c in ("column", "table", "owner")]
    )))
    known = names.unionByName(local_rows(spark, [(f"k{i}",) for i in range(50)], "name string")).distinct()
    programs = events.select(F.concat(F.lit("PKG_"), "user_id").alias("name")).distinct()
    return deps.unknown_references(scripts, known, programs)


_RISKS = {
    "view": "UPDATE t SET a = 1", "click": "TRUNCATE  TABLE t", "signup": "DELETE FROM t WHERE a = 1 -- DROP TABLE t",
    "purchase": "GRANT SELECT ON t TO u; ALTER TABLE t\n DROP COLUMN a", "error": "procedure p IS BEGIN drop table t; END;",
}
_RISKS_FOUND = [
    ("view", "changes every row"), ("click", "truncates a table"), ("purchase", "changes privileges"),
    ("purchase", "drops a column or constraint"), ("error", "drops an object"), ("error", "is only the body of a routine"),
]


@query(
    "G7",
    "SELECT event_id AS script, risk FROM events JOIN (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in _RISKS_FOUND)
    + ") v(kind, risk) ON kind = event_type",
)
def risky_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in _RISKS.items() for x in pair])
    code = F.concat(F.lit("/* "), "user_id", F.lit(" */\n"), kinds[F.col("event_type")])
    bare = F.when(F.col("event_type") == "error", kinds[F.col("event_type")]).otherwise(code)
    return deps.risky_scripts(table(spark, sf_dir, "events").select(F.col("event_id").alias("script"), bare.alias("code")))


# ------------------------------------------------------------------ small scalars


@query(
    "F17",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN json_extract_string(props, '$.k')::BIGINT ELSE 0 END AS n FROM events",
)
def forgiving_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read from text: what is no number, and what is missing, is 0."""
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, k)
    return table(spark, sf_dir, "events").select("event_id", count_or_zero(text).alias("n"))


@query(
    "T3",
    "SELECT 50 AS max_rows, (SELECT count(*) FROM events WHERE event_type = 'error') >= 50 AS capped UNION ALL "
    "SELECT 1000000, (SELECT count(*) FROM events WHERE event_type = 'error') >= 1000000",
)
def capped_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    flags = [capped(errors, n).select(F.lit(n).alias("max_rows"), "capped") for n in (50, 1000000)]
    return flags[0].unionByName(flags[1])
