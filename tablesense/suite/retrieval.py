"""Retrieval queries over documents, over the catalog, and over links in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesense.functions.text import STOPWORDS_ENGLISH, STOPWORDS_ROMANIAN, ENDINGS, content_words, question_words
from tablesense.operators import retrieve
from tablesense.plans import fk_discovery
from tablesense.sources.tables import local_rows, settled
from tablesense.suite import estate as given_tables
from tablesense.suite.catalogs import _COUNTS, _EDGES_SQL
from tablesense.suite.estate import OWNERS, table
from tablesense.suite.registry import query

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS_ENGLISH + STOPWORDS_ROMANIAN)
_ENDING = f"^(.{{4,}}?)(?:{'|'.join(ENDINGS)})$"


def _words_sql(text: str) -> str:
    """The distinct stems of a text as an SQL list."""
    stem = "w"
    for _ in range(3):
        stem = rf"regexp_replace({stem}, '{_ENDING}', '\1')"
    return (
        f"list_distinct(list_transform(list_filter(regexp_extract_all(strip_accents(lower({text})), '[a-z][a-z0-9]*'), "
        f"lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), lambda w: {stem}))"
    )


@query(
    "F9 F10",
    f"SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_words, md5(array_to_string(list_sort(ws), ' ')) AS words_md5 "
    f"FROM (SELECT doc_id, {_words_sql('text')} AS ws FROM documents)",
)
def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded, filtered and stemmed words of every whole document."""
    words = table(spark, sf_dir, "documents").select("doc_id", content_words(F.col("text")).alias("ws"))
    return words.select(
        "doc_id", F.size("ws").alias("n_words"), F.md5(F.array_join(F.array_sort("ws"), " ")).alias("words_md5")
    )


_QUESTION = "Où sont les éléments de la nation? which erblest, inonble or ciónez orders from src3"
_ASKED = ", ".join(f"'{w}'" for w in question_words(_QUESTION))


def _relevance_sql(corpus: str, key: str, fields: dict[str, float], asked: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, unnest({_words_sql(f'coalesce({c}, {chr(39) * 2})')}) AS word, {w}::DOUBLE AS weight FROM {corpus}"
        for c, w in fields.items()
    )
    return (
        f"WITH h AS (SELECT {key}, word, sum(weight) AS weight FROM ({parts}) WHERE word IN ({asked}) GROUP BY ALL), "
        f"t AS (SELECT count(*) AS n FROM {corpus}), d AS (SELECT word, count(*) AS df FROM h GROUP BY 1), "
        f"s AS (SELECT {key}, sum(weight * ln(1 + n / df::DOUBLE) / ln(1 + n)) AS score FROM h JOIN d USING (word), t GROUP BY ALL) "
    )


_DOC_FIELDS = {"source": retrieve.NAME, "text": retrieve.PURPOSE}


@query(
    "R1 A21 F11",
    _relevance_sql("documents", "doc_id", _DOC_FIELDS, _ASKED) + "SELECT doc_id, round(score, 6) AS score FROM s",
)
def document_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a word with the question, scored by field and rarity."""
    scores = retrieve.relevance(table(spark, sf_dir, "documents"), ["doc_id"], _DOC_FIELDS, _QUESTION)
    return scores.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "R1 W3 T1",
    _relevance_sql("documents", "doc_id", _DOC_FIELDS, _ASKED)
    + "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 6) DESC, doc_id LIMIT 20",
)
def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = retrieve.relevance(table(spark, sf_dir, "documents"), ["doc_id"], _DOC_FIELDS, _QUESTION)
    rounded = scores.withColumn("score", F.round("score", 6))
    return retrieve.ranked(rounded, 20, tie_break=["doc_id"])


@query(
    "A21",
    f"WITH w AS (SELECT unnest({_words_sql('text')}) AS word FROM documents), n AS (SELECT count(*) AS n FROM documents) "
    "SELECT word, count(*) AS rows, round(ln(1 + max(n) / count(*)::DOUBLE) / ln(1 + max(n)), 9) AS rarity FROM w, n GROUP BY word",
)
def word_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every word of the corpus is worth as evidence."""
    found = retrieve.corpus_rarity(table(spark, sf_dir, "documents"), "text")
    return found.withColumn("rarity", F.round("rarity", 9))


# ------------------------------------------------------------------ links in the data


def _delivery_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers linked by deliveries, both ways."""
    lines = table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")
    return lines.select(F.inline(F.array(
        F.struct(part.alias("source"), supplier.alias("target")), F.struct(supplier.alias("source"), part.alias("target"))
    )))


_EDGES = (
    "e AS (SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target FROM lineitem UNION ALL "
    "SELECT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem)"
)


@query(
    "J15",
    f"WITH {_EDGES}, s AS (SELECT 'P' || p_partkey AS node FROM part WHERE p_brand = 'Brand#2') "
    "SELECT target AS node, count(*) AS links FROM e WHERE source IN (FROM s) AND target NOT IN (FROM s) GROUP BY 1",
)
def one_hop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers one delivery away from the parts of a brand, with their number of links."""
    seeds = table(spark, sf_dir, "part").filter("p_brand = 'Brand#2'").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return retrieve.one_hop(_delivery_edges(spark, sf_dir), seeds)


@query("A20", f"WITH {_EDGES} SELECT source AS node, count(*) AS degree FROM e GROUP BY 1")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.degree(_delivery_edges(spark, sf_dir))


@query(
    "U4",
    "SELECT event_type AS owner, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS place FROM "
    "(SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)",
)
def owners_in_first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("owner"), F.col("event_id").alias("ordinal"))
    return retrieve.first_seen(seen, "owner", "ordinal")


# ------------------------------------------------------------------ the map of the estate


def _map(spark: SparkSession, sf_dir: str, question: str):
    """Scored tables of the estate, and the discovered relationships between them."""
    estate, scored = _scored(spark, sf_dir, question)
    return estate, scored, settled(fk_discovery.discover(estate))


def _scored(spark: SparkSession, sf_dir: str, question: str):
    estate = given_tables.given(spark, sf_dir)
    texts = retrieve.table_texts(estate.tables(), estate.columns(), None, None)
    found = retrieve.relevance(texts, ["owner", "table"], retrieve.TABLE_FIELDS, question)
    places = local_rows(spark, [(o, t, i) for i, (o, t) in enumerate(estate.keys())], "owner string, table string, place int")
    scored = places.join(found, ["owner", "table"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return estate, settled(scored)


_TABLE_FIELD_SQL = "(SELECT table_name AS t, replace(table_name, '_', ' ') AS name_text, coalesce(c.comment, '') AS purpose_text, " \
    "(SELECT string_agg(replace(column_name, '_', ' '), ' ') FROM information_schema.columns i WHERE i.table_name = k.table_name) " \
    "AS columns_text FROM (SELECT DISTINCT table_name FROM information_schema.columns WHERE table_name IN (" \
    + ", ".join(f"'{t}'" for names in OWNERS.values() for t in names) + ")) k LEFT JOIN (VALUES ('orders', 'Customer orders'), " \
    "('customer', 'Customers of the shop')) c(table_name, comment) USING (table_name))"
_MAP_FIELDS = {"name_text": retrieve.NAME, "purpose_text": retrieve.PURPOSE, "columns_text": retrieve.COLUMN}
_MAP_QUESTION = "Which customers placed orders with a high priority?"
_MAP_ASKED = ", ".join(f"'{w}'" for w in question_words(_MAP_QUESTION))


@query(
    "R1 R2",
    _relevance_sql(_TABLE_FIELD_SQL, "t", _MAP_FIELDS, _MAP_ASKED)
    + "SELECT c.table_name AS \"table\", round(coalesce(s.score, 0) + CASE WHEN c.table_name IN ('lineitem', 'part') THEN 12 ELSE 0 END "
    f"+ CASE WHEN c.table_name = 'events' THEN 4 ELSE 0 END, 6) AS score, num_rows FROM ({_COUNTS}) c LEFT JOIN s ON s.t = c.table_name",
)
def boosted_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table scores with boosts for what earlier queries used and for a log; earlier queries come from events."""
    estate, scored = _scored(spark, sf_dir, _MAP_QUESTION)
    used = F.concat(F.lit("select "), "event_type", F.lit(" from SALES.lineitem l join part p on l.x = p.x"))
    history = table(spark, sf_dir, "events").select(used.alias("sql"))
    named = settled(retrieve.tables_in_queries(history, estate.tables()))
    logs = estate.tables().filter("table = 'events'")
    scores = retrieve.boosted(scored, [(named, retrieve.HISTORY), (logs, retrieve.LOG)])
    return scores.join(estate.row_counts(), ["owner", "table"]).select(
        "table", F.round("score", 6).alias("score"), "num_rows"
    )


@query(
    "R3 J15 W3",
    "SELECT * FROM (VALUES ('customer', 'direct'), ('orders', 'direct'), ('lineitem', 'context'), ('nation', 'context')) v(\"table\", part)",
)
def map_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables for a question: direct hits, and the tables one discovered reference away."""
    _, scored, relationships = _map(spark, sf_dir, _MAP_QUESTION)
    return retrieve.select_tables(scored, relationships).select("table", "part")


@query(
    "R3 A20",
    f"WITH e AS (SELECT * FROM (VALUES {_EDGES_SQL}) v(a, c, b, d)), n AS (SELECT t, count(*) AS degree FROM "
    "(SELECT a AS t FROM e WHERE a <> b UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY 1) "
    "SELECT t AS \"table\", 'fallback' AS part FROM n ORDER BY degree DESC, "
    "CASE t WHEN 'customer' THEN 0 WHEN 'lineitem' THEN 1 WHEN 'nation' THEN 2 WHEN 'orders' THEN 3 ELSE 9 END LIMIT 4",
)
def map_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question without any known word gets the most connected tables."""
    _, scored, relationships = _map(spark, sf_dir, "zzz qqq")
    return retrieve.select_tables(scored, relationships, limit=4).select("table", "part")


@query(
    "R5 T5",
    f"SELECT table_name AS \"table\", num_rows FROM ({_COUNTS}) WHERE table_name NOT IN ('customer', 'orders', 'lineitem', 'nation')",
)
def omitted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the selection left out, named and with its size."""
    estate, scored, relationships = _map(spark, sf_dir, _MAP_QUESTION)
    kept = settled(retrieve.select_tables(scored, relationships).select("owner", "table"))
    names, _ = retrieve.omitted(estate.tables().select("owner", "table"), kept)
    return names.join(estate.row_counts(), ["owner", "table"]).select("table", "num_rows")


# ------------------------------------------------------------------ programs

_PROGRAM_QUESTION = "red widgets: economy prices for orders"
_PROGRAM_ASKED = ", ".join(f"'{w}'" for w in question_words(_PROGRAM_QUESTION))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as programs: named by their name, with their type as routine and the tables they touch by size."""
    part = table(spark, sf_dir, "part")
    used = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("SALES.orders"), F.lit("lineitem"))).otherwise(F.array(F.lit("SALES.part")))
    return part.select(
        F.lit("SALES").alias("owner"), F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("name"),
        F.array("p_type").alias("routines"), F.concat_ws(" ", "p_brand", F.lit("price")).alias("summary"), used.alias("tables_used"),
    )


def _shared_sql(text: str) -> str:
    return f"len(list_intersect({_words_sql(text)}, [{_PROGRAM_ASKED}]))"


_PROGRAM_SCORES = (
    "SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name, "
    f"10.0 * {_shared_sql('p_name')} + CASE WHEN {_shared_sql('p_type')} > 0 THEN 10.0 ELSE 0 END + "
    f"3.0 * {_shared_sql("p_brand || ' price'")} + "
    "CASE WHEN p_size % 2 = 0 THEN 4.0 ELSE 0 END AS score FROM part"
)


@query("R4", f"SELECT name, score::DOUBLE AS score FROM ({_PROGRAM_SCORES}) ")
def selected_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = local_rows(spark, [("SALES", "orders"), ("SALES", "lineitem")], "owner string, table string")
    scores = retrieve.program_scores(_programs(spark, sf_dir), kept, _PROGRAM_QUESTION)
    return retrieve.select_programs(scores).select("name", "score")


@query("R2", "SELECT * FROM (VALUES ('lineitem'), ('orders'), ('part')) v(\"table\")")
def tables_of_named_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.programs_named(_programs(spark, sf_dir), _PROGRAM_QUESTION)
