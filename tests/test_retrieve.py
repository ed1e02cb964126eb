"""Words, relevance, selection of tables and programs, fan-out, evaluation and meanings."""

import pytest
from pyspark.sql import functions as F

from tablesense.functions.text import content_words, question_words, stem_word
from tablesense.operators import evaluate, fanout, findings, meaning, retrieve
from tablesense.plans import fk_discovery
from tablesense.sources.catalog import COLUMN_SCHEMA, CONSTRAINT_SCHEMA, TABLE_SCHEMA
from tablesense.sources.tables import local_rows

EDGE = (
    "owner string, table string, columns array<string>, parent_owner string, parent_table string, parent_columns array<string>"
)
BANK = {
    "ACCOUNTS": "ACCOUNT_ID CUSTOMER_ID STATUS BALANCE", "CARDS": "CARD_ID ACCOUNT_ID EXPIRES_AT",
    "CUSTOMERS": "CUSTOMER_ID FULL_NAME COUNTRY", "ERROR_LOG": "ERROR_ID LOG_TIME SEVERITY MESSAGE",
    "FEE_CHARGE": "FEE_ID ACCOUNT_ID AMOUNT", "LOANS": "LOAN_ID CUSTOMER_ID PRINCIPAL",
    "TRANSACTIONS": "TXN_ID ACCOUNT_ID AMOUNT TXN_DATE", **{f"ST_MISC_{i:02}": "ID CODE VALUE" for i in range(1, 13)},
}
LINKS = [
    ("ACCOUNTS", "CUSTOMER_ID", "CUSTOMERS"), ("TRANSACTIONS", "ACCOUNT_ID", "ACCOUNTS"), ("CARDS", "ACCOUNT_ID", "ACCOUNTS"),
    ("LOANS", "CUSTOMER_ID", "CUSTOMERS"), ("FEE_CHARGE", "ACCOUNT_ID", "ACCOUNTS"),
]


def words(make, text):
    return set(make([(text,)], "t string").select(content_words(F.replace("t", F.lit("_"), F.lit(" ")))).collect()[0][0])


def test_words_are_folded_filtered_and_stemmed(make):
    assert words(make, "Câte conturi avem pe fiecare status?") == {"cont", "statu"}
    assert words(make, "ACCOUNT_ID") == words(make, "account id") == {"account"}
    assert words(make, "customers") == words(make, "customer")
    assert words(make, "conturi") == words(make, "cont")
    assert words(make, "tranzactii") == words(make, "tranzacție")


@pytest.mark.parametrize("word", ["conturilor", "clientelor", "accounts", "fees", "tranzactiile", "es", "abcdes", "miiii"])
def test_both_stemmers_agree(make, word):
    assert words(make, word) <= {stem_word(word)}


def test_questions_meet_the_other_language():
    assert {"fee", "comision"} <= set(question_words("cate comision"))
    assert "account" in question_words("conturi") and "cont" in question_words("accounts")


def relationships(spark):
    return local_rows(spark, [("B", c, [col], "B", p, [col]) for c, col, p in LINKS], EDGE)


def scored(spark, question):
    columns = local_rows(
        spark, [("B", t, i, c, "VARCHAR2", None, None, None, True, None) for t, cs in BANK.items() for i, c in enumerate(cs.split())], COLUMN_SCHEMA
    )
    tables = local_rows(spark, [("B", t, None, None) for t in BANK], TABLE_SCHEMA)
    texts = retrieve.table_texts(tables, columns, None, None)
    found = retrieve.relevance(texts, ["owner", "table"], retrieve.TABLE_FIELDS, question)
    places = local_rows(spark, [("B", t, i) for i, t in enumerate(sorted(BANK))], "owner string, table string, place int")
    return places.join(found, ["owner", "table"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def parts(spark, question, **options):
    rows = retrieve.select_tables(scored(spark, question), relationships(spark), **options).collect()
    return {r["table"]: r["part"] for r in rows}


def test_named_tables_are_direct_and_the_bridge_comes_along(spark):
    found = parts(spark, "charges and cards per customer")
    assert found["FEE_CHARGE"] == found["CARDS"] == found["CUSTOMERS"] == "direct"
    assert found["ACCOUNTS"] == "context"
    assert not any(t.startswith("ST_MISC") for t in found)


def test_a_question_without_known_words_gets_the_most_connected_tables(spark):
    found = parts(spark, "zzz", limit=2)
    assert found == {"ACCOUNTS": "fallback", "CUSTOMERS": "fallback"}
    assert set(parts(spark, "zzz")) == set(BANK)


def test_a_small_map_is_kept_whole(spark):
    assert set(parts(spark, "fees", whole=True).values()) == {"whole"}


def test_boosts_for_history_and_logs(spark, make):
    history = make([("SELECT * FROM B.loans l",), ("select 1 from ghosts",)], "sql string")
    tables = local_rows(spark, [("B", t, None, None) for t in BANK], TABLE_SCHEMA)
    named = retrieve.tables_in_queries(history, tables)
    assert [r["table"] for r in named.collect()] == ["LOANS"]
    scores = retrieve.boosted(scored(spark, "now by year"), [(named, retrieve.HISTORY)])
    assert scores.filter("table = 'LOANS'").collect()[0]["score"] == 12.0
    logs = tables.filter("table = 'ERROR_LOG'")
    kept = tables.filter("table = 'LOANS'")
    assert retrieve.select_logs(logs, kept, "latest errors").count() == 1
    assert retrieve.select_logs(logs, kept, "balances").count() == 0


def test_omitted_tables_are_named_and_counted(spark):
    tables = local_rows(spark, [("B", t, None, None) for t in BANK], TABLE_SCHEMA)
    names, count = retrieve.omitted(tables, tables.filter("table IN ('LOANS', 'CARDS')"))
    assert names.count() == len(BANK) - 2 and count.collect()[0]["omitted"] == len(BANK) - 2


def test_relevance_matches_a_direct_computation(spark, make):
    import math

    docs = [(i, f"alpha {'beta ' * (i % 3)} {'gamma' if i % 5 == 0 else ''}") for i in range(40)]
    rows = retrieve.relevance(make(docs, "i int, t string"), ["i"], {"t": 3.0}, ["alpha", "beta", "gamma", "nowhere"]).collect()
    held = {i: {w for w in ("alpha", "beta", "gamma") if w in t} for i, t in docs}
    df = {w: sum(w in ws for ws in held.values()) for w in ("alpha", "beta", "gamma")}
    want = {i: sum(3 * math.log(1 + 40 / df[w]) / math.log(41) for w in ws) for i, ws in held.items() if ws}
    assert {r["i"]: round(r["score"], 9) for r in rows} == {i: round(s, 9) for i, s in want.items()}


def test_programs_rank_by_name_summary_and_tables(spark, make):
    programs = make(
        [("B", "LOAN_AGING", ["age_loans"], "ages loans", ["B.LOANS"]), ("B", "PRINT", [], "prints", ["CARDS"]), ("B", "OTHER", [], "", [])],
        "owner string, name string, routines array<string>, summary string, tables_used array<string>",
    )
    kept = local_rows(spark, [("B", "CARDS")], "owner string, table string")
    rows = retrieve.select_programs(retrieve.program_scores(programs, kept, "loans"), limit=2).collect()
    # 'loans' also asks for its three equivalents, of which only loan occurs
    assert [(r["name"], r["score"]) for r in rows] == [("LOAN_AGING", 23.0), ("PRINT", 2.0)]
    assert [r["table"] for r in retrieve.programs_named(programs, "loans").collect()] == ["LOANS"]


# ------------------------------------------------------------------ fan-out


def fan_out(spark, make, tables):
    used = make([(1, t) for t in tables], "query int, table string")
    return {r["parent"]: r["children"] for r in fanout.fan_out_parents(relationships(spark), used).collect()}


def test_siblings_fan_out_and_chains_do_not(spark, make):
    assert fan_out(spark, make, ["ACCOUNTS", "cards", "FEE_CHARGE"]) == {"ACCOUNTS": ["CARDS", "FEE_CHARGE"]}
    assert fan_out(spark, make, ["CUSTOMERS", "ACCOUNTS", "CARDS"]) == {}
    assert fan_out(spark, make, ["CARDS", "FEE_CHARGE"]) == {}


def test_rollup_does_not_multiply(make):
    parent = make([(1,), (2,), (3,)], "id int")
    fees, alerts = make([(1, 10), (1, 20), (2, 5)], "k int, amount int"), make([(1,), (1,), (1,)], "k int")
    rows = fanout.safe_rollup(parent, "id", {
        "fees": (fees, "k", [F.sum("amount").alias("fees")]), "alerts": (alerts, "k", [F.count("*").alias("alerts")]),
    }).collect()
    assert {r["id"]: (r["fees"], r["alerts"]) for r in rows} == {1: (30, 3), 2: (5, None), 3: (None, None)}
    factor = {r["detail"]: (r["joined_rows"], r["factor"]) for r in fanout.fan_out_factor(parent, "id", {"fees": (fees, "k"), "alerts": (alerts, "k")}).collect()}
    assert factor == {"fees": (6, 3.0), "alerts": (6, 2.0)}


# ------------------------------------------------------------------ evaluation and findings


def test_recall_precision_and_missed(spark):
    truth = local_rows(spark, [("S", "orders", ["Cust_Id"], "S", "CUSTOMERS", ["ID"]), ("S", "X", ["b", "a"], "S", "Y", ["b", "a"])], EDGE)
    found = local_rows(spark, [("S", "ORDERS", ["CUST_ID"], "T", "customers", ["ID"]), ("S", "Z", ["q"], "S", "Y", ["q"])], EDGE)
    score = evaluate.fk_score(truth, found).collect()[0]
    assert (score["truth_total"], score["found_total"], score["matched"], score["recall"], score["precision"]) == (2, 2, 1, 0.5, 0.5)
    assert [r["missed"] for r in evaluate.missed_edges(truth, found).collect()] == ["X(A,B) -> Y"]
    assert evaluate.fk_score(truth, found, strict=True).collect()[0]["matched"] == 0
    nothing = evaluate.fk_score(truth.limit(0), found.limit(0)).collect()[0]
    assert (nothing["recall"], nothing["precision"]) == (0.0, 0.0)


def test_coverage_counts_only_sure_meanings(make):
    documented = make([("A",), ("b",), ("C",)], "table string")
    recovered = make([("a", "high"), ("B", "low"), ("c", "medium"), ("d", "high")], "table string, confidence string")
    row = evaluate.coverage(documented, recovered, ["table"]).collect()[0]
    assert (row["documented"], row["recovered"]) == (3, 2)


def test_findings(spark):
    columns = local_rows(spark, [
        ("S", "A", 1, "CREATED_DT", "DATE", None, None, None, True, "when"), ("S", "A", 2, "CODE", "NUMBER", None, None, None, True, " "),
        ("S", "B", 1, "ORDER_DATE", "DATE", None, None, None, True, None), ("S", "B", 2, "CODE", "VARCHAR2", None, None, None, True, "c"),
    ], COLUMN_SCHEMA)
    tables = local_rows(spark, [("S", "A", "about a", 1), ("S", "B", "  ", 1)], TABLE_SCHEMA)
    parts = findings.all_findings(
        findings.type_inconsistencies(columns), findings.naming_inconsistencies(columns), findings.missing_comments(tables, columns)
    )
    rows = {(r["kind"], r["table"]): r for r in parts.collect()}
    assert rows["type_inconsistency", None]["message"] == "CODE has several types: NUMBER in A; VARCHAR2 in B."
    assert "_DT and _DATE" in rows["naming_inconsistency", None]["message"]
    assert rows["missing_table_comment", "B"]["severity"] == "info"
    assert rows["missing_column_comment", "A"]["details"] == {"uncommented": "1", "total": "2"}
    assert {r["kind"]: r["findings"] for r in findings.by_kind(parts).collect()}["missing_column_comment"] == 2


def test_orphans_are_reported_with_their_relationship(estate):
    sources = estate({
        ("S", "P"): ([(i,) for i in range(10)], "AREA_CD int", {"primary_key": ("AREA_CD",)}),
        ("S", "C"): ([(i % 11,) for i in range(22)], "AREA_CD int", {}),
    })
    found = fk_discovery.discover(sources)
    rows = {r["kind"]: r for r in findings.relationship_findings(found).collect()}
    assert rows["orphan_rows"]["details"] == {"orphan_rows": "2", "overlap": "0.9091"}
    assert rows["undeclared_fk_candidate"]["severity"] == "notice"
    counters = findings.report_counters(sources.tables(), found, findings.relationship_findings(found)).collect()[0]
    assert (counters["tables"], counters["inferred"], counters["declared"], counters["findings"]) == (2, 1, 0, 2)


# ------------------------------------------------------------------ meanings


def test_meanings_follow_the_rule_order(spark):
    columns = local_rows(spark, [
        ("S", "ORDER_ITEMS", i, c, "NUMBER", None, None, None, True, note)
        for i, (c, note) in enumerate([
            ("ITEM_ID", None), ("ORDER_ID", None), ("UNIT_PRICE", None), ("EMAIL_NAME", None), ("SHIP_NO", None), ("ODD", None), ("CITY_CODE", "the city"),
        ])
    ], COLUMN_SCHEMA)
    constraints = local_rows(spark, [("S", "ORDER_ITEMS", "PK", "P", ["ITEM_ID"], None, None, None)], CONSTRAINT_SCHEMA)
    links = local_rows(
        spark, [("S", "ORDER_ITEMS", ["ORDER_ID"], "S", "ORDERS", ["ORDER_ID"], "exact")], EDGE + ", rule string"
    )
    keyed = meaning.key_roles(columns, constraints, links)
    found = {r["column"]: (r["meaning"], r["confidence"]) for r in meaning.column_meanings(meaning.column_summaries(keyed)).collect()}
    assert found["ITEM_ID"] == ("Primary key of a order item", "high")
    assert found["ORDER_ID"] == ("Foreign key to ORDERS.ORDER_ID (found by its values)", "medium")
    assert found["UNIT_PRICE"] == ("Probably sum of money", "medium")
    assert found["EMAIL_NAME"] == ("Probably mail address", "high")
    assert found["SHIP_NO"][1] == found["ODD"][1] == "low"
    assert found["CITY_CODE"] == ("the city", "high")
    tables = local_rows(spark, [("S", "ORDER_ITEMS", None, 1)], TABLE_SCHEMA)
    assert meaning.table_purposes(tables, keyed, links).collect()[0]["confidence"] == "low"
    index = {r["table"]: (r["outbound"], r["inbound"]) for r in meaning.relationship_index(links).collect()}
    assert index == {"ORDER_ITEMS": (["S.ORDERS"], []), "ORDERS": ([], ["S.ORDER_ITEMS"])}
