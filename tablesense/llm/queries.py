"""The registered queries over the training-data operators, each applied to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm import (
    bpe, decontamination, fingerprints, html_extraction, line_dedup, mixing, near_dedup, phrases, quality, token_output, toxicity, url_filters, whitening,
)
from tablesense.llm.common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = table(spark, sf_dir, "documents"), fold(5) == 0
    net = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score(documents, net, "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = table(spark, sf_dir, "documents"), fold(3) == 1
    model = quality.fit(documents, table(spark, sf_dir, "labels"), ~held)
    scored = quality.score(documents, model, "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _draw(text: str, most: int):
    """A number below ``most`` from the text's md5, the same in every engine."""
    return f"conv(substring(md5({text}), 1, 6), 16, 10) % {most}"


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated lists of the pages' own hosts against the pages, fetched on days that follow from page_id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filters.host().alias("h")).where("h <> ''").distinct()
    day = "cast(date_add(date '2024-01-01', cast({} as int)) as timestamp)"
    entries = None
    for name, allows, kind, value, share, events in (
        ("domains", False, "domain", "regexp_extract(h, '[^.]+[.][^.]+[.][^.]+$', 0)", 3, (("add", "0"), ("remove", "90"), ("add", "150"))),
        ("paths", False, "prefix", "concat(h, '/en')", 4, (("add", "30"), ("remove", "200"))),
        ("trusted", True, "host", "h", 5, (("add", "60"),)),
    ):
        for action, days in events:
            at = day.format(f"{_draw(f"concat(h, '{name}')", 300)} + {days}")
            rows = hosts.where(f"{_draw(f"concat('{name}', h)", share)} = 0").selectExpr(
                f"'{name}' as list", f"{str(allows).lower()} as allows", f"'{kind}' as kind", f"{value} as value", f"{at} as at", f"'{action}' as action"
            )
            entries = rows if entries is None else entries.unionAll(rows)
    captures = pages.selectExpr("page_id as capture", "url", f"{day.format(_draw('cast(page_id as string)', 540))} as at")
    found = url_filters.evaluate(captures, entries)
    return found.select(F.col("capture").alias("page_id"), "url", "host", F.col("at").alias("fetched_at"), "n_active", "active_list", "active_since", "blocked")


OP3_SQL = r"""
WITH hosts AS (
    SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS h FROM pages
), log AS (
    SELECT 'domains' AS list, false AS allows, regexp_extract(h, '[^.]+[.][^.]+[.][^.]+$', 0) AS value, 'domain' AS kind, e.action,
        TIMESTAMP '2024-01-01' + to_days(CAST(('0x' || substr(md5(h || 'domains'), 1, 6))::BIGINT % 300 + e.days AS INTEGER)) AS moment
    FROM hosts, (VALUES ('add', 0), ('remove', 90), ('add', 150)) e(action, days) WHERE h <> '' AND ('0x' || substr(md5('domains' || h), 1, 6))::BIGINT % 3 = 0
    UNION ALL
    SELECT 'paths', false, h || '/en', 'prefix', e.action, TIMESTAMP '2024-01-01' + to_days(CAST(('0x' || substr(md5(h || 'paths'), 1, 6))::BIGINT % 300 + e.days AS INTEGER))
    FROM hosts, (VALUES ('add', 30), ('remove', 200)) e(action, days) WHERE h <> '' AND ('0x' || substr(md5('paths' || h), 1, 6))::BIGINT % 4 = 0
    UNION ALL
    SELECT 'trusted', true, h, 'host', 'add', TIMESTAMP '2024-01-01' + to_days(CAST(('0x' || substr(md5(h || 'trusted'), 1, 6))::BIGINT % 300 + 60 AS INTEGER))
    FROM hosts WHERE h <> '' AND ('0x' || substr(md5('trusted' || h), 1, 6))::BIGINT % 5 = 0
), days AS (
    SELECT list, allows, kind, value, moment, bool_or(action = 'add') AS added FROM log GROUP BY ALL
), spans AS (
    SELECT * FROM (SELECT *, lead(moment) OVER (PARTITION BY list, kind, value ORDER BY moment) AS until FROM days) WHERE added
), captures AS (
    SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
        TIMESTAMP '2024-01-01' + to_days(CAST(('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 540 AS INTEGER)) AS moment FROM pages
), hits AS (
    SELECT c.page_id, count(*) AS n, min(s.list) AS list, max(s.moment) AS since, bool_or(s.allows) AS allowed FROM captures c JOIN spans s
        ON c.moment >= s.moment AND (s.until IS NULL OR c.moment < s.until) AND CASE s.kind WHEN 'host' THEN c.host = s.value
            WHEN 'domain' THEN c.host = s.value OR ends_with(c.host, '.' || s.value)
            ELSE c.host || '/en' = s.value AND regexp_matches(c.url, '^[^:]+://[^/?#]*/en([/?#]|$)') END
    GROUP BY c.page_id
)
SELECT c.page_id, c.url, c.host, c.moment AS fetched_at, coalesce(n, 0) AS n_active, list AS active_list, since AS active_since,
    coalesce(n, 0) > 0 AND NOT coalesce(allowed, false) AS blocked
FROM captures c LEFT JOIN hits ON hits.page_id = c.page_id
"""


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), whole_runs=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.token_path(spark)
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json")
    return token_output.read_tokens(spark, path)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the text that they spell again."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "doc_id")
    texts = bpe.decode(ids, "byte_bpe_50k.json", "doc_id", "ids")
    return texts.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality, op3_url_filters, op4_minhash_near_dedup, op5_mixing, op6_fingerprints, op7_line_dedup, op8_decontamination,
        op9_token_output, op10_html_extraction, op11_phrases, op12_whitening, op13_bpe,
    )
}
LLM_SQL = {"op3_url_filters": OP3_SQL, "op7_line_dedup": line_dedup.SQL, "op11_phrases": phrases.SQL}
