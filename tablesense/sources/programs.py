"""Stored program texts: assembled source lines, triggers and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablesense.functions.privacy import strip

# Lines of one unit are first joined in stretches of this many, so that no single aggregation
# buffer holds every line of a very long unit before they are text.
LINES_PER_STRETCH = 1000


def _joined(parts: list[Column], text: Column) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(*parts, text.alias("piece"))))
    return F.array_join(F.transform(ordered, lambda p: p["piece"]), "")


def assemble_source(
    lines: DataFrame, kinds: dict[str, str] | None = None, *, lines_per_stretch: int = LINES_PER_STRETCH
) -> DataFrame:
    """(owner, name, type, line, text) -> one text per unit, in (type, line) order.

    A package's specification sorts before its body; ``kinds`` maps such types to one unit kind.
    The kind of a unit is the kind of its first type.
    """
    stretch = F.floor(F.col("line") / lines_per_stretch).alias("stretch")
    stretches = lines.groupBy("owner", "name", "type", stretch).agg(
        _joined([F.col("line")], F.coalesce("text", F.lit(""))).alias("piece_text")
    )
    units = stretches.groupBy("owner", "name").agg(
        F.min("type").alias("first_type"),
        strip(_joined([F.col("type"), F.col("stretch")], F.col("piece_text"))).alias("source"),
    )
    kind: Column = F.col("first_type")
    if kinds:
        pairs = [F.lit(x) for pair in kinds.items() for x in pair]
        kind = F.coalesce(F.create_map(*pairs)[F.col("first_type")], F.lit("PROCEDURE"))
    return units.select("owner", "name", kind.alias("kind"), "source")


def trigger_units(triggers: DataFrame) -> DataFrame:
    """(owner, name, event, table, header, body) -> the trigger's text with a leading event note."""
    event = F.concat(F.lit("-- "), F.col("event"), F.lit(" ON "), F.col("table"))
    parts = F.array(event, strip(F.coalesce("header", F.lit(""))), strip(F.coalesce("body", F.lit(""))))
    return triggers.select(
        "owner", "name", F.lit("TRIGGER").alias("kind"),
        F.array_join(F.filter(parts, lambda p: p != ""), "\n").alias("source"),
    )


def view_units(views: DataFrame) -> DataFrame:
    return views.select(
        "owner", "name", F.lit("VIEW").alias("kind"),
        strip(F.coalesce("text", F.lit(""))).alias("source"),
    )


def program_units(*kinds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, kinds)


def program_overview(units: DataFrame, summaries: DataFrame, objects: DataFrame) -> DataFrame:
    """Units with their summary and their validity, both optional.

    ``summaries``: owner, name, kind, summary, confidence; ``objects``: owner, name, type, status.
    """
    status = objects.select(
        F.upper("owner").alias("o"), F.upper("name").alias("n"), F.upper("type").alias("k"), "status"
    )
    found = units.join(summaries, ["owner", "name", "kind"], "left")
    same = (
        (F.upper(F.coalesce("owner", F.lit(""))) == F.col("o"))
        & (F.upper("name") == F.col("n"))
        & (F.upper("kind") == F.col("k"))
    )
    empty = F.lit("")
    return found.join(status, same, "left").select(
        "owner", "name", "kind",
        F.coalesce("summary", empty).alias("summary"),
        F.coalesce("confidence", empty).alias("confidence"),
        F.coalesce("status", empty).alias("status"),
        F.coalesce("source", empty).alias("source"),
    )
