"""Candidate foreign keys from names and types alone: joins over the catalog.

All four rules return the same columns: rule, owner, table, columns, parent_owner, parent_table,
parent_columns, parent_order (catalog order of the parent, then of the column choice).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesense.functions.names import base_type, trailing_token, type_signature
from tablesense.sources.catalog import Estate
from tablesense.sources.tables import settled

CANDIDATE = [
    "rule", "owner", "table", "columns", "parent_owner", "parent_table", "parent_columns",
    "parent_order", "child_type", "parent_type", "child_is_key", "parent_is_key",
]


class CatalogFrames:
    """The catalog as the rules read it: typed columns, keys in catalog order, declared references.

    Owners come in scan order, tables by name within an owner, keys by constraint name. The frames
    are settled here once, so that the rules join small local relations and empty ones drop out.
    """

    def __init__(self, tables: DataFrame, columns: DataFrame, constraints: DataFrame, owners: list[str]):
        signature = type_signature(*[F.col(c) for c in ("data_type", "length", "precision", "scale")])
        self.columns = settled(columns.select(
            "owner", "table", "ordinal", "column", signature.alias("signature"),
            base_type(signature).alias("base"), trailing_token(F.col("column")).alias("token"),
        ))
        rank = F.array_position(F.array(*[F.lit(o) for o in owners]), F.col("owner"))
        keys = constraints.filter(F.col("kind").isin("P", "U")).join(tables.select("owner", "table"), ["owner", "table"])
        place = F.row_number().over(W.orderBy(rank, "table", "name"))
        self.keys = settled(keys.withColumn("key_order", place))
        self.declared = settled(constraints.filter("kind = 'R'").select("owner", "table", "columns").distinct())

    @classmethod
    def of(cls, estate: Estate) -> "CatalogFrames":
        owners = list(dict.fromkeys(owner for owner, _ in estate.keys()))
        return cls(estate.tables(), estate.columns(), estate.constraints(), owners)

    @cached_property
    def single_keys(self) -> DataFrame:
        """Single-column keys once per constraint, with the type and token of the key column."""
        is_primary = F.max(F.col("kind") == "P").over(W.partitionBy("owner", "table", "columns"))
        single = self.keys.filter(F.size("columns") == 1).select(
            "owner", "table", F.col("columns")[0].alias("column"), "key_order", is_primary.alias("is_primary")
        )
        return settled(single.join(self.columns.drop("ordinal"), ["owner", "table", "column"]))

    @cached_property
    def parents(self) -> DataFrame:
        return self.single_keys.select(
            F.col("owner").alias("parent_owner"), F.col("table").alias("parent_table"),
            F.col("column").alias("parent_column"), F.col("base").alias("parent_type"),
            F.col("token").alias("parent_token"), F.col("key_order").alias("parent_order"),
            F.col("is_primary").alias("parent_is_key"),
        )

    @cached_property
    def composite_keys(self) -> DataFrame:
        return self.keys.filter(F.size("columns") >= 2).select(
            F.col("owner").alias("parent_owner"), F.col("table").alias("parent_table"),
            F.col("columns").alias("parent_columns"), F.col("key_order"),
        )

    def undeclared(self, candidates: DataFrame) -> DataFrame:
        """Leave out children whose columns already carry a declared foreign key."""
        return candidates.join(self.declared, ["owner", "table", "columns"], "left_anti")

    def flagged(self, candidates: DataFrame) -> DataFrame:
        """Mark children that are their own table's single-column primary key."""
        own = self.keys.filter((F.col("kind") == "P") & (F.size("columns") == 1)).select(
            "owner", "table", "columns", F.lit(True).alias("own")
        )
        joined = candidates.join(own, ["owner", "table", "columns"], "left")
        return joined.withColumn("child_is_key", F.coalesce("own", F.lit(False)))


def without_known_empty(frame: DataFrame, empty: DataFrame | None, prefix: str = "") -> DataFrame:
    """Leave out tables measured as empty (owner, table); unmeasured tables stay."""
    if empty is None:
        return frame
    names = empty.select(
        F.col("owner").alias(f"{prefix}owner"), F.col("table").alias(f"{prefix}table")
    )
    return frame.join(names, [f"{prefix}owner", f"{prefix}table"], "left_anti")


def measured_empty(counts: DataFrame) -> DataFrame:
    return counts.filter("num_rows = 0").select("owner", "table")


def _finish(df: DataFrame, rule: str) -> DataFrame:
    return df.withColumn("rule", F.lit(rule)).select(*CANDIDATE)


def _single(catalog: CatalogFrames, matches: DataFrame, rule: str) -> DataFrame:
    shaped = matches.withColumns({
        "columns": F.array("column"), "parent_columns": F.array("parent_column"),
        "parent_order": F.array("parent_order"), "child_type": F.col("signature"),
    })
    return _finish(catalog.flagged(catalog.undeclared(shaped)), rule)


def exact_name(catalog: CatalogFrames) -> DataFrame:
    """Columns named exactly like a single-column key of another table, whatever their type."""
    named = catalog.columns.join(catalog.parents, F.col("column") == F.col("parent_column"))
    return _single(catalog, named.filter(_other_table()), "exact")


def unambiguous(candidates: DataFrame) -> DataFrame:
    """Without data only a child with a single possible parent is kept."""
    parents = F.count(F.lit(1)).over(W.partitionBy("owner", "table", "columns"))
    return candidates.withColumn("n", parents).filter("n = 1").drop("n")


def same_suffix(catalog: CatalogFrames) -> DataFrame:
    """Columns sharing the trailing token and base type of a single-column key.

    Finds role-named and self references; a column that is its own table's key is no reference.
    """
    own_keys = catalog.single_keys.select("owner", "table", "column").distinct()
    children = catalog.columns.join(own_keys, ["owner", "table", "column"], "left_anti")
    matches = (F.col("token") == F.col("parent_token")) & (F.col("base") == F.col("parent_type"))
    return _single(catalog, children.join(catalog.parents, matches), "suffix")


def _other_table() -> Column:
    return (F.col("owner") != F.col("parent_owner")) | (F.col("table") != F.col("parent_table"))


def _composite(catalog: CatalogFrames, df: DataFrame, rule: str) -> DataFrame:
    blank = F.lit(None).cast("string")
    flags = {"child_type": blank, "parent_type": blank, "child_is_key": F.lit(False), "parent_is_key": F.lit(False)}
    return _finish(catalog.undeclared(df.withColumns(flags)), rule)


def composite_exact(catalog: CatalogFrames) -> DataFrame:
    """Tables that carry every column of another table's composite key."""
    parts = catalog.composite_keys.withColumn("column", F.explode("parent_columns"))
    held = (
        catalog.columns.select("owner", "table", "column").join(parts, "column").filter(_other_table())
        .groupBy("owner", "table", "parent_owner", "parent_table", "parent_columns", "key_order")
        .agg(F.count(F.lit(1)).alias("held"))
        .filter(F.col("held") == F.size("parent_columns"))
        .withColumns({"columns": F.col("parent_columns"), "parent_order": F.array("key_order")})
    )
    return _composite(catalog, held, "composite_exact")


def composite_positions(catalog: CatalogFrames) -> DataFrame:
    """Columns that fit one position of another table's composite key by token and base type, as single pairs."""
    shaped = _unnamed(_positions(catalog)).select(
        "owner", "table", F.array("column").alias("columns"), "parent_owner", "parent_table", F.array("part").alias("parent_columns")
    )
    return shaped.distinct()


def _positions(catalog: CatalogFrames) -> DataFrame:
    typed = catalog.columns
    parts = catalog.composite_keys.select("*", F.posexplode("parent_columns").alias("position", "part"))
    part_types = typed.select(
        F.col("owner").alias("parent_owner"), F.col("table").alias("parent_table"),
        F.col("column").alias("part"), F.col("token").alias("part_token"), F.col("base").alias("part_base"),
    )
    parts = parts.join(part_types, ["parent_owner", "parent_table", "part"])
    like = (F.col("token") == F.col("part_token")) & (F.col("base") == F.col("part_base"))
    return typed.join(parts, like).filter(_other_table())


_MATCH = ["owner", "table", "parent_owner", "parent_table", "parent_columns", "key_order"]


def _unnamed(positions: DataFrame) -> DataFrame:
    """Without the keys whose exact names a table has all; those are ``composite_exact``'s."""
    named = positions.groupBy(*_MATCH, "position").agg(F.max(F.col("column") == F.col("part")).alias("has_name"))
    whole = named.groupBy(*_MATCH).agg(F.min("has_name").alias("all_names"), F.count(F.lit(1)).alias("places"))
    return positions.join(whole.filter(~F.col("all_names") & (F.col("places") == F.size("parent_columns"))), _MATCH, "left_semi")


def composite_suffix(catalog: CatalogFrames, fitting: DataFrame | None = None) -> DataFrame:
    """Column choices that match a composite key position by position, by token and base type.

    A key is left alone when its exact names are all present or when a position has no match.
    ``fitting`` holds the single pairs of ``composite_positions`` whose values overlap enough: a tuple
    overlaps no more than its parts, so only those columns are combined.
    """
    child = _MATCH
    positions = _unnamed(_positions(catalog))
    if fitting is not None:
        fits = fitting.select(
            "owner", "table", F.col("columns")[0].alias("column"), "parent_owner", "parent_table", F.col("parent_columns")[0].alias("part")
        )
        positions = positions.join(fits.distinct(), fits.columns, "left_semi")
    per_position = positions.groupBy(*child, "position").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "column"))).alias("options")
    )
    per_key = (
        per_position.groupBy(*child)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "options"))), lambda p: p["options"]
            ).alias("options"),
        )
        .filter(F.size("options") == F.size("parent_columns"))
        .withColumn(
            "choices", F.aggregate("options", F.lit(1).cast("bigint"), lambda n, o: n * F.size(o))
        )
    )
    # Number the choices, and read the digits of the number position by position.
    numbered = per_key.withColumn("choice", F.explode(F.sequence(F.lit(0), (F.col("choices") - 1).cast("int"))))

    def pick(option: Column, i: Column) -> Column:
        after = F.slice("options", i + 2, F.size("options"))
        step = F.aggregate(after, F.lit(1).cast("bigint"), lambda n, o: n * F.size(o))
        return F.get(option, ((F.floor(F.col("choice") / step)) % F.size(option)).cast("int"))["column"]

    found = (
        numbered.withColumn("columns", F.transform("options", pick))
        .filter(F.size(F.array_distinct("columns")) == F.size("columns"))
        .withColumn("parent_order", F.array(F.col("key_order"), F.col("choice")))
    )
    return _composite(catalog, found, "composite_suffix")
