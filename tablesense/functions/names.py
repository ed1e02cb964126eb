"""Expressions over table, column and type names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trailing_token(name: Column) -> Column:
    """The text after the last underscore: MANAGER_ID -> ID, PRICE -> PRICE."""
    return F.substring_index(name, "_", -1)


def name_tokens(name: Column) -> Column:
    return F.split(F.upper(name), "_")


def base_type(type_text: Column) -> Column:
    """NUMBER(10,2) -> NUMBER."""
    return F.substring_index(type_text, "(", 1)


def type_signature(data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """NUMBER(p,s) when a precision or scale is known, CHAR-like types with length, else bare."""
    upper = F.upper(data_type)
    scale_or_zero = F.coalesce(scale, F.lit(0))
    number = F.concat(
        F.lit("NUMBER("),
        F.coalesce(precision.cast("string"), F.lit("*")),
        F.lit(","),
        scale_or_zero.cast("string"),
        F.lit(")"),
    )
    sized_types = ("VARCHAR2", "CHAR", "NVARCHAR2", "NCHAR", "RAW")
    has_digits = precision.isNotNull() | (scale_or_zero != 0)
    sized = upper.isin(*sized_types) & (F.coalesce(length, F.lit(0)) != 0)
    return (
        F.when((upper == "NUMBER") & has_digits, number)
        .when(sized, F.concat(upper, F.lit("("), length.cast("string"), F.lit(")")))
        .otherwise(upper)
    )


def singular(table: Column) -> Column:
    """ORDER_ITEMS -> 'order item'."""
    return F.regexp_replace(F.replace(F.lower(table), F.lit("_"), F.lit(" ")), "s$", "")


def blank(col: Column) -> Column:
    """True for a null or all-space text."""
    return F.coalesce(F.trim(col), F.lit("")) == ""


def name_contains(name: Column, needle: str) -> Column:
    """Case-insensitive name search; the empty needle finds everything."""
    return F.contains(F.lower(name), F.lit(needle.strip().lower()))
