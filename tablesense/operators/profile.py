"""Profiles of columns: counts, lengths, shapes and masked samples, and no raw value.

All columns of a table are melted to (column, value) and counted once; everything else is
derived from the distinct values, so each value is shaped and masked once however often it occurs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesense.functions.keys import key_text
from tablesense.functions.privacy import mask_value, structural_pattern
from tablesense.sources.tables import local_rows, united

LOW_CARDINALITY_MAX = 25
PATTERNS, SAMPLES = 4, 3


def _cells(df: DataFrame, columns: Mapping[str, str | int]) -> DataFrame:
    """(column, value) for every cell, values as text."""
    cells = [
        F.struct(F.lit(label).alias("column"), key_text(F.col(f"`{c}`"), df.schema[c].dataType).alias("value"))
        for c, label in columns.items()
    ]
    return df.select(F.inline(F.array(*cells)))


def _counted(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n_rows); nulls are counted under a null value."""
    return _counted(_cells(df, {c: c for c in columns}))


def estate_value_counts(tables: Sequence[tuple[DataFrame, Mapping[str, str | int]]]) -> DataFrame:
    """The same over many tables, columns labelled as given: one scan per table and one shuffle in all."""
    return _counted(united([_cells(df, numbers) for df, numbers in tables]))


def null_fraction(nulls: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(nulls / total, 4)).otherwise(F.lit(0.0))


def low_cardinality(distinct: Column, total: Column) -> Column:
    return (distinct > 0) & (distinct <= LOW_CARDINALITY_MAX) & (distinct < F.greatest(total, F.lit(1)))


def _top(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows of each column; the limit is applied before and after the shuffle."""
    place = F.row_number().over(W.partitionBy("column").orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= limit)


def _kept(condition: Column) -> Column:
    """A condition that stays above the counting. Alone it would be pushed below it, where values
    would be shaped once per row instead of once per distinct value, and the branches that share
    the counts would no longer be the same plan."""
    return F.when(F.col("n_rows") > 0, condition)


def top_patterns(counts: DataFrame, limit: int = PATTERNS) -> DataFrame:
    """(column, place, pattern, n_rows): the most frequent shapes, then by shape."""
    shaped = counts.filter(_kept(F.col("value").isNotNull())).select(
        "column", structural_pattern(F.col("value")).alias("pattern"), "n_rows"
    )
    grouped = shaped.groupBy("column", "pattern").agg(F.sum("n_rows").alias("n_rows"))
    return _top(grouped, [F.desc("n_rows"), F.asc("pattern")], limit)


def masked_samples(counts: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """(column, place, masked): the first distinct masks, in value order or by ``first_seen``."""
    order = "first_seen" if "first_seen" in counts.columns else "value"
    masked = counts.filter(_kept(F.col("value").isNotNull())).select(
        "column", mask_value(F.col("value")).alias("masked"), F.col(order).alias("first"), "n_rows"
    )
    grouped = masked.filter(_kept(F.col("masked") != "")).groupBy("column", "masked").agg(F.min("first").alias("first"))
    return _top(grouped, [F.asc("first"), F.asc("masked")], limit)


def _listed(df: DataFrame, text: str, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("place", text)))
    return df.groupBy("column").agg(F.transform(ordered, lambda p: p[text]).alias(name))


def _measures(counts: DataFrame) -> DataFrame:
    value, n = F.col("value"), F.col("n_rows")
    return counts.groupBy("column").agg(
        F.sum(n).alias("total_rows"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count(value).alias("distinct_count"),
        F.min(F.length(value)).alias("min_length"),
        F.max(F.length(value)).alias("max_length"),
    )


def _with_flags(measures: DataFrame) -> DataFrame:
    total = F.col("total_rows")
    return measures.withColumns({
        "null_fraction": null_fraction(F.col("null_count"), total),
        "is_low_cardinality": low_cardinality(F.col("distinct_count"), total),
    })


def measures(counts: DataFrame) -> DataFrame:
    return _with_flags(_measures(counts))


def column_measures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact row, null and distinct counts and text lengths of each column."""
    return _for_all(measures(value_counts(df, columns)), _names(df, columns))


def approximate_measures(df: DataFrame, columns: Sequence[str], *, error: float = 0.02) -> DataFrame:
    """The same facts with sketched distinct counts: one scan, no shuffle of values."""
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(columns):
        text = key_text(F.col(f"`{c}`"), df.schema[c].dataType)
        aggregates += [
            F.count(text).alias(f"filled_{i}"), F.approx_count_distinct(text, error).alias(f"distinct_{i}"),
            F.min(F.length(text)).alias(f"min_{i}"), F.max(F.length(text)).alias(f"max_{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col("total").alias("total_rows"),
            (F.col("total") - F.col(f"filled_{i}")).alias("null_count"),
            F.col(f"distinct_{i}").alias("distinct_count"),
            F.col(f"min_{i}").alias("min_length"), F.col(f"max_{i}").alias("max_length"),
        )
        for i, c in enumerate(columns)
    ]
    return _with_flags(df.agg(*aggregates).select(F.inline(F.array(*cells))))


def _names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return local_rows(df.sparkSession, [(c,) for c in columns], "column string")


def _for_all(measured: DataFrame, names: DataFrame) -> DataFrame:
    """A row for every column, also of a table without rows."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_rows", "null_count", "distinct_count")}
    full = names.join(measured, "column", "left").withColumns(zero)
    return full.withColumns({
        "null_fraction": F.coalesce("null_fraction", F.lit(0.0)),
        "is_low_cardinality": F.coalesce("is_low_cardinality", F.lit(False)),
    })


def profile_counts(counts: DataFrame, names: DataFrame, *, samples: bool = True) -> DataFrame:
    """Value counts to profiles, one row per row of ``names`` (its key is ``column``)."""
    full = _for_all(measures(counts), names)
    if not samples:
        return full
    patterns = _listed(top_patterns(counts), "pattern", "value_patterns")
    masks = _listed(masked_samples(counts), "masked", "masked_samples")
    empty = F.array().cast("array<string>")
    return full.join(patterns, "column", "left").join(masks, "column", "left").withColumns({
        "value_patterns": F.coalesce("value_patterns", empty),
        "masked_samples": F.coalesce("masked_samples", empty),
    })


def profile_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: measures, up to four patterns, up to three masked samples."""
    return profile_counts(value_counts(df, columns), _names(df, columns))
