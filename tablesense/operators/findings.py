"""What is wrong with an estate: orphans, undeclared keys, mixed types and names, missing comments.

Every finding has the columns kind, severity, owner, table, columns, message and details.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablesense.functions.names import blank
from tablesense.sources.tables import local_rows

# Endings that mean the same.
SYNONYM_SUFFIXES = (("_DT", "_DATE"), ("_NO", "_NUM"), ("_CD", "_CODE"), ("_ID", "_KEY"))
FINDING = ["kind", "severity", "owner", "table", "columns", "message", "details"]


def _finding(df: DataFrame, kind: str, severity: str, message: Column, **given: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    values = {
        "owner": none, "table": none, "columns": F.array().cast("array<string>"),
        "details": F.create_map().cast("map<string,string>"), **given,
    }
    return df.select(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
        *[values[c].alias(c) for c in ("owner", "table", "columns")],
        message.alias("message"), values["details"].alias("details"),
    )


def _ends(relationships: DataFrame) -> tuple[Column, Column]:
    parent = F.when(F.col("cross_schema"), F.concat_ws(".", "parent_owner", "parent_table")).otherwise(F.col("parent_table"))
    child_text = F.format_string("%s(%s)", "table", F.array_join("columns", ", "))
    return child_text, F.format_string("%s(%s)", parent, F.array_join("parent_columns", ", "))


def relationship_findings(relationships: DataFrame) -> DataFrame:
    """Orphan rows and undeclared keys, from inferred relationships."""
    inferred = relationships.filter(~F.col("declared"))
    child, parent = _ends(inferred)
    place = {"owner": F.col("owner"), "table": F.col("table"), "columns": F.col("columns")}
    details = F.create_map(
        F.lit("orphan_rows"), F.col("orphan_rows").cast("string"),
        F.lit("overlap"), F.round("overlap", 4).cast("string"),
    )
    orphans = _finding(
        inferred.filter(F.col("overlap").isNotNull() & (F.col("orphan_rows") > 0)), "orphan_rows", "warning",
        F.format_string("%s: %d row(s) without a match in %s.", child, "orphan_rows", parent),
        details=details, **place,
    )
    undeclared = _finding(
        inferred, "undeclared_fk_candidate", "notice",
        F.format_string("%s probably refers to %s (%s confidence).", child, parent, "confidence"), **place,
    )
    return orphans.unionByName(undeclared)


def type_inconsistencies(columns: DataFrame) -> DataFrame:
    """Column names that have more than one type across tables."""
    base = F.upper("data_type")
    per_type = columns.groupBy("column", base.alias("type")).agg(
        F.array_join(F.array_sort(F.collect_list("table")), ", ").alias("tables")
    )
    mixed = per_type.groupBy("column").agg(
        F.array_sort(F.collect_list(F.format_string("%s in %s", "type", "tables"))).alias("uses")
    ).filter(F.size("uses") > 1)
    message = F.format_string("%s has several types: %s.", "column", F.array_join("uses", "; "))
    return _finding(mixed, "type_inconsistency", "warning", message, columns=F.array("column"))


def naming_inconsistencies(columns: DataFrame) -> DataFrame:
    """Synonymous endings of which both are in use."""
    names = columns.select(F.upper("column").alias("column")).distinct()
    endings = [(i, side, ending) for i, pair in enumerate(SYNONYM_SUFFIXES) for side, ending in enumerate(pair)]
    # The endings a name has are found in a projection, so no theta join is needed.
    held = F.filter(
        F.array(*[
            F.when(F.endswith("column", F.lit(e)), F.struct(F.lit(i).alias("pair"), F.lit(s).alias("side")))
            for i, s, e in endings
        ]),
        lambda x: x.isNotNull(),
    )
    pairs = local_rows(columns.sparkSession, [(i, a, b) for i, (a, b) in enumerate(SYNONYM_SUFFIXES)],
                       "pair int, first string, second string")
    used = names.select("column", F.inline(held)).groupBy("pair").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("column")))).alias("firsts"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("column")))).alias("seconds"),
    )
    mixed = used.filter((F.size("firsts") > 0) & (F.size("seconds") > 0)).join(pairs, "pair")
    message = F.format_string(
        "Both %s and %s are in use: %s beside %s.", "first", "second",
        F.array_join("firsts", ", "), F.array_join("seconds", ", "),
    )
    return _finding(mixed, "naming_inconsistency", "notice", message)


def missing_comments(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables without a comment, and per table how many columns have none."""
    place = {"owner": F.col("owner"), "table": F.col("table")}
    bare = _finding(
        tables.filter(blank(F.col("comment"))), "missing_table_comment", "info",
        F.format_string("%s has no comment.", "table"), **place,
    )
    per_table = columns.groupBy("owner", "table").agg(
        F.count(F.lit(1)).alias("total"),
        F.array_sort(F.collect_list(
            F.when(blank(F.col("comment")), F.struct("ordinal", "column"))
        )).alias("bare"),
    ).filter(F.size("bare") > 0)
    uncommented = F.size("bare")
    columns_bare = _finding(
        per_table, "missing_column_comment", "info",
        F.format_string("%d of %d columns of %s have no comment.", uncommented, "total", "table"),
        columns=F.transform("bare", lambda b: b["column"]),
        details=F.create_map(
            F.lit("uncommented"), uncommented.cast("string"), F.lit("total"), F.col("total").cast("string")
        ), **place,
    )
    return bare.unionByName(columns_bare)


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("findings"))


def report_counters(tables: DataFrame, relationships: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: tables, declared and inferred relationships, findings."""
    facts = relationships.agg(
        F.count_if(F.col("declared")).alias("declared"), F.count_if(~F.col("declared")).alias("inferred")
    )
    counted = {"tables": tables, "findings": findings}
    return facts.withColumns(
        {name: df.agg(F.count(F.lit(1)).alias("n")).scalar() for name, df in counted.items()}
    )
