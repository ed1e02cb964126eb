"""Results as JSON or CSV files."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def write_report(frames: Mapping[str, DataFrame], path: str) -> None:
    """One JSON directory per frame of a report."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(os.path.join(path, name))


def read_report(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType | str]) -> dict[str, DataFrame]:
    """The frames of a written report; schemas are given, never inferred."""
    return {n: spark.read.schema(s).json(os.path.join(path, n)) for n, s in schemas.items()}


def csv_cell(col: Column) -> Column:
    """Quoted only where a comma, quote or line break asks for it; null is the empty cell."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def csv_line(columns: Sequence[str]) -> Column:
    return F.array_join(F.array(*[csv_cell(F.col(f"`{c}`")) for c in columns]), ",")


def write_csv(df: DataFrame, path: str) -> None:
    """A grid as CSV with CRLF line ends: ``path/header``, then the parts of ``path/rows``.

    Put end to end they are one file. Spark's own CSV writer would turn line breaks inside a cell
    into the line separator, so lines are made here and written as text.
    """
    header = df.sparkSession.range(1).select(csv_cell_list(df.columns).alias("line"))
    for name, lines in (("header", header.coalesce(1)), ("rows", df.select(csv_line(df.columns).alias("line")))):
        lines.write.mode("overwrite").option("lineSep", "\r\n").text(os.path.join(path, name))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a written grid; cells keep their line breaks and quotes, empty cells are null.

    A row whose only cell is empty is an empty line and is not read. Quoted line breaks keep a part from being
    split, so parallelism is that of the parts written.
    """
    options = {"multiLine": True, "quote": '"', "escape": '"', "header": False, "lineSep": "\r\n", "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options).csv(os.path.join(path, "rows"))


def csv_cell_list(values: Sequence[str]) -> Column:
    return F.array_join(F.array(*[csv_cell(F.lit(v)) for v in values]), ",")


def sort_grid(
    df: DataFrame, column: str, *, ascending: bool = True, tie_break: Sequence[str] = ()
) -> DataFrame:
    """A grid by one column, nulls last; numbers by value, numeric texts by their number first."""
    col = F.col(f"`{column}`")
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    keys = [col] if numeric else [col.cast("string").try_cast("double"), col.cast("string")]
    # Nulls sort last upwards and first downwards, because turning the order turns them too.
    ordered = [k.asc_nulls_last() if ascending else k.desc_nulls_first() for k in keys]
    return df.orderBy(*ordered, *tie_break)
