"""Joins that repeat rows: detecting them, and aggregating without them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def fan_out_parents(relationships: DataFrame, used: DataFrame) -> DataFrame:
    """Parents used together with two or more of their own children.

    ``used``: (query, table), the tables of each query. A chain is harmless, and so is a table
    that refers to itself. Names are compared without owner and case.
    """
    edges = relationships.select(
        F.upper("table").alias("child"), F.upper("parent_table").alias("parent")
    ).filter("child <> parent").distinct()
    names = used.select("query", F.upper("table").alias("name")).distinct()
    children = names.join(edges, F.col("name") == F.col("child")).select("query", "child", "parent")
    both = children.join(
        names.select(F.col("query").alias("q"), F.col("name").alias("parent_name")),
        (F.col("query") == F.col("q")) & (F.col("parent") == F.col("parent_name")),
    )
    grouped = both.groupBy("query", "parent").agg(F.array_sort(F.collect_set("child")).alias("children"))
    return grouped.filter(F.size("children") > 1)


def detail_counts(parent: DataFrame, parent_key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(parent key, n_<child>...): how many rows each detail has per parent."""
    counts = parent.select(F.col(parent_key))
    for name, (child, fk) in children.items():
        per_key = child.groupBy(F.col(fk).alias(parent_key)).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        counts = counts.join(per_key, parent_key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return counts


def fan_out_factor(parent: DataFrame, parent_key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """How often a join of all details repeats their rows, per detail, without doing the join.

    joined_rows is the size of the inner join of the parent with all details, summed from the
    counts per key; the factor of a detail is joined_rows over its rows that take part.
    """
    counts = detail_counts(parent, parent_key, children)
    columns = [F.col(f"n_{name}") for name in children]
    product, together = columns[0], columns[0] > 0
    for c in columns[1:]:
        product, together = product * c, together & (c > 0)
    facts = counts.filter(together).agg(
        F.sum(product).alias("joined_rows"), *[F.sum(c).alias(name) for name, c in zip(children, columns)]
    )
    cells = [F.struct(F.lit(name).alias("detail"), F.col(name).alias("detail_rows")) for name in children]
    per_detail = facts.select("joined_rows", F.inline(F.array(*cells)))
    return per_detail.withColumn("factor", F.col("joined_rows") / F.col("detail_rows"))


def safe_rollup(
    parent: DataFrame, parent_key: str, children: Mapping[str, tuple[DataFrame, str, Sequence[Column]]]
) -> DataFrame:
    """The parent with aggregates of each detail, every detail aggregated on its own first.

    Each detail is reduced to one row per key before it is joined, so no row is counted twice and
    a key with a third of a detail's rows is combined before the shuffle.
    """
    result = parent
    for child, fk, aggregates in children.values():
        per_key = child.groupBy(F.col(fk).alias(parent_key)).agg(*aggregates)
        result = result.join(per_key, parent_key, "left")
    return result
