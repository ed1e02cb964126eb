"""Score findings against a ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesense.functions.grading import HIGH, MEDIUM


def _upper_set(columns: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(columns, F.upper)))


def _edges(found: DataFrame, strict: bool) -> DataFrame:
    """Edges in comparable form: table, unordered columns, parent; strict adds owners and parent columns."""
    names = {"child": F.upper("table"), "cols": _upper_set(F.col("columns")), "parent": F.upper("parent_table")}
    if strict:
        names |= {
            "child_owner": F.upper("owner"), "parent_owner": F.upper("parent_owner"),
            "parent_cols": _upper_set(F.col("parent_columns")),
        }
    return found.select(*[c.alias(n) for n, c in names.items()]).distinct()


def matched_edges(truth: DataFrame, found: DataFrame, *, strict: bool = False) -> DataFrame:
    return _edges(truth, strict).intersect(_edges(found, strict))


def missed_edges(truth: DataFrame, found: DataFrame, *, strict: bool = False) -> DataFrame:
    missed = _edges(truth, strict).exceptAll(_edges(found, strict))
    text = F.concat("child", F.lit("("), F.array_join("cols", ","), F.lit(") -> "), "parent")
    return missed.select(text.alias("missed"))


def fk_score(truth: DataFrame, found: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row: truth, found, matched, recall and precision (0 where nothing could match)."""
    real, seen = _edges(truth, strict).withColumn("real", F.lit(1)), _edges(found, strict).withColumn("seen", F.lit(1))
    keys = [c for c in real.columns if c != "real"]
    both = real.join(seen, keys, "full")
    facts = both.agg(
        F.count("real").alias("truth_total"), F.count("seen").alias("found_total"),
        F.count_if(F.col("real").isNotNull() & F.col("seen").isNotNull()).alias("matched"),
    )
    return facts.withColumns({
        "recall": _share("matched", "truth_total"), "precision": _share("matched", "found_total")
    })


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def coverage(documented: DataFrame, recovered: DataFrame, keys: list[str]) -> DataFrame:
    """Of the documented items, how many got a meaning of at least medium confidence."""
    names = {k: F.upper(k) for k in keys}
    items = documented.select(*[c.alias(k) for k, c in names.items()]).distinct()
    good = recovered.filter(F.col("confidence").isin(HIGH, MEDIUM)).select(
        *[c.alias(k) for k, c in names.items()]
    ).distinct().withColumn("good", F.lit(1))
    facts = items.join(good, keys, "left").agg(
        F.count(F.lit(1)).alias("documented"), F.count("good").alias("recovered")
    )
    return facts.withColumn("coverage", _share("recovered", "documented"))
