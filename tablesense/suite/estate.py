"""The given tables as an estate: three owners, their keys, and no declared foreign keys."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesense.sources.catalog import Estate, Source
from tablesense.sources.tables import read_parquet

OWNERS = {
    "SALES": ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"),
    "APP": ("events", "conversations"),
    "CORPUS": ("documents", "labels", "pages", "benchmark", "embeddings"),
}
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",),
    "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "conversations": ("conv_id", "turn"), "documents": ("doc_id",),
    "pages": ("page_id",), "benchmark": ("item_id",), "embeddings": ("vec_id",),
}
LARGE_TEXT = {
    "documents": ("text",), "conversations": ("text",), "pages": ("html",), "benchmark": ("text",),
}
# The true references between the given tables.
TRUTH = [
    ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"),
    ("lineitem", "l_suppkey", "supplier"), ("orders", "o_custkey", "customer"),
    ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"),
    ("nation", "n_regionkey", "region"), ("labels", "doc_id", "documents"),
]
COMMENTS = {
    "orders": ("Customer orders", {"o_orderkey": "Order number", "o_custkey": "Ordering customer"}),
    "customer": ("Customers of the shop", {"c_name": "Full name", "c_acctbal": " "}),
    "events": (None, {"ts": "When it happened"}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"))


def given(spark: SparkSession, sf_dir: str) -> Estate:
    sources = {}
    for owner, names in OWNERS.items():
        for name in names:
            comment, column_comments = COMMENTS.get(name, (None, {}))
            sources[owner, name] = Source(
                table(spark, sf_dir, name), primary_key=KEYS.get(name, ()), comment=comment,
                column_comments=column_comments, large_text=LARGE_TEXT.get(name, ()),
            )
    return Estate(spark, sources)


def staff(spark: SparkSession, sf_dir: str) -> Estate:
    """Suppliers as employees who report to each other, in departments that are nations.

    The contact list of another owner refers to both.
    """
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    employees = supplier.select(
        F.col("s_suppkey").alias("employee_id"),
        (F.col("s_suppkey") - F.col("s_suppkey") % 3).alias("manager_id"),
        F.col("s_nationkey").alias("department_id"),
    )
    departments = nation.select(F.col("n_nationkey").alias("department_id"), F.col("n_name").alias("name"))
    contacts = customer.select(
        F.col("c_custkey").alias("contact_no"),
        (F.col("c_custkey") % 97).alias("rep_id"),
        F.col("c_nationkey").cast("string").alias("department_id"),
    )
    return Estate(spark, {
        ("HR", "departments"): Source(departments, primary_key=("department_id",)),
        ("HR", "employees"): Source(employees, primary_key=("employee_id",)),
        ("EXT", "contacts"): Source(contacts, primary_key=("contact_no",)),
    })


def dialogues(spark: SparkSession, sf_dir: str) -> Estate:
    """Turns with a two-column key, a table of the same names and one with role names."""
    turns = table(spark, sf_dir, "conversations")
    ratings = turns.select(
        F.xxhash64("conv_id", "turn").alias("rating_no"), "conv_id", "turn",
        F.length("text").alias("score"),
    )
    replies = turns.select(
        F.xxhash64("turn", "conv_id").alias("reply_no"), F.col("conv_id").alias("source_id"),
        (F.col("turn") + 1).alias("next_turn"), F.col("turn").alias("source_turn"),
    )
    return Estate(spark, {
        ("APP", "ratings"): Source(ratings, primary_key=("rating_no",)),
        ("APP", "replies"): Source(replies, primary_key=("reply_no",)),
        ("APP", "turns"): Source(turns, primary_key=("conv_id", "turn"), large_text=("text",)),
    })


def twins(spark: SparkSession, sf_dir: str) -> Estate:
    """Two tables whose unrelated keys share a name and a value range, and a true reference."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return Estate(spark, {
        ("SALES", "customer"): Source(customer, primary_key=("c_custkey",)),
        ("SALES", "prospect"): Source(
            customer.select("c_custkey", F.col("c_name").alias("p_name")), primary_key=("c_custkey",)
        ),
        ("SALES", "receipt"): Source(
            orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("c_custkey")),
            primary_key=("o_orderkey",),
        ),
    })


def applications(spark: SparkSession, sf_dir: str) -> Estate:
    """Events, orders and turns under the names an application's own logs have.

    The length of a text column is the longest value measured in it.
    """
    events, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    turns = table(spark, sf_dir, "conversations")
    error_log = events.select(
        F.col("event_id").alias("error_id"), F.col("ts").alias("log_time"), F.col("event_type").alias("severity"),
        (F.col("user_id") % 7).alias("error_code"), F.col("user_id").alias("module"),
        F.col("props").alias("message"),
    )
    audit_trail = events.select(
        F.col("event_id").alias("audit_num"), F.col("ts").alias("event_time"), F.col("event_type").alias("action"),
        F.col("user_id").alias("changed_by"), F.col("props").alias("details"),
    )
    job_run_log = orders.select(
        F.col("o_orderkey").alias("run_no"), F.col("o_orderpriority").alias("job_name"),
        F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"),
    )
    transactions = orders.select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.col("o_orderdate").alias("created_dt"),
        F.col("o_orderpriority").alias("details"),
    )
    remarks = turns.select("conv_id", "turn", F.col("text").alias("remark"), F.col("conv_id").alias("log_date"))
    frames = {
        "audit_trail": (audit_trail, ("audit_num",)), "error_log": (error_log, ("error_id",)),
        "job_run_log": (job_run_log, ("run_no",)), "remarks": (remarks, ("conv_id", "turn")),
        "transactions": (transactions, ("txn_id",)),
    }
    return Estate(spark, {
        ("APP", name): Source(df, primary_key=key) for name, (df, key) in frames.items()
    })


def with_measured_lengths(columns: DataFrame, estate: Estate) -> DataFrame:
    """Catalog columns with the length of text columns measured: one aggregation per table, no shuffle of values."""
    parts = []
    for (owner, name), source in estate.sources.items():
        texts = [f.name for f in source.rows.schema.fields if f.dataType.typeName() == "string"]
        longest = source.rows.agg(*[F.max(F.length(c)).alias(c) for c in texts])
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("measured")) for c in texts]
        if texts:
            parts.append(longest.select(
                F.lit(owner).alias("owner"), F.lit(name).alias("table"), F.inline(F.array(*cells))
            ))
    measured = parts[0]
    for part in parts[1:]:
        measured = measured.unionByName(part)
    joined = columns.join(measured, ["owner", "table", "column"], "left")
    return joined.withColumn("length", F.coalesce("measured", "length")).select(*columns.columns)


def staff_with_declared_keys(spark: SparkSession, sf_dir: str) -> Estate:
    """``staff`` with two references declared, one of them to another owner, and claims that refer to order lines by two columns."""
    plain = staff(spark, sf_dir).sources
    lines = table(spark, sf_dir, "lineitem")
    keys = F.col("l_orderkey").alias("order_number"), F.col("l_linenumber").alias("line_number")
    place = ("order_number", "line_number")
    employees, contacts = plain["HR", "employees"], plain["EXT", "contacts"]
    return Estate(spark, {
        ("HR", "departments"): plain["HR", "departments"],
        ("HR", "employees"): replace(employees, foreign_keys=((("department_id",), "HR", "departments", ("department_id",)),)),
        ("EXT", "contacts"): replace(contacts, foreign_keys=((("rep_id",), "HR", "employees", ("employee_id",)),)),
        ("EXT", "order_lines"): Source(lines.where("l_quantity > 1").select(*keys), primary_key=place),
        ("EXT", "claims"): Source(
            lines.where("l_returnflag = 'R'").select(*keys, F.col("l_extendedprice").alias("amount")),
            foreign_keys=((place, "EXT", "order_lines", place),),
        ),
    })
