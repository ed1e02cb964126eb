"""Rediscover undeclared foreign keys of an estate from names plus measured value overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesense.functions.grading import HIGH, overlap_confidence, percent
from tablesense.functions.names import base_type, trailing_token
from tablesense.operators import candidates as rules
from tablesense.operators.inclusion import MEASURE_TYPES, MEASURES, inclusion
from tablesense.sources.catalog import Estate
from tablesense.sources.tables import local_rows, settled

RELATIONSHIP = [
    "owner", "table", "columns", "parent_owner", "parent_table", "parent_columns", "declared",
    "rule", "confidence", "evidence", "overlap", "orphan_rows", "cross_schema",
]


RULES = (rules.exact_name, rules.same_suffix, rules.composite_exact)


def all_candidates(
    estate: Estate, *, counts: DataFrame | None = None, fitting: DataFrame | None = None, catalog: rules.CatalogFrames | None = None
) -> DataFrame:
    """Candidates of all four rules; with row counts, without the tables measured as empty.

    ``fitting`` are the measured single pairs that composite keys may be combined from.
    """
    catalog = catalog or rules.CatalogFrames.of(estate)
    found = reduce(DataFrame.unionByName, [*(rule(catalog) for rule in RULES), rules.composite_suffix(catalog, fitting)])
    if counts is None:
        return found
    empty = rules.measured_empty(counts)
    return rules.without_known_empty(rules.without_known_empty(found, empty), empty, "parent_")


def discover(
    estate: Estate,
    *,
    threshold: float = 0.85,
    counts: DataFrame | None = None,
    empty_is_null: bool = False,
) -> DataFrame:
    """Inferred relationships, one row each.

    Pairs of columns stay a DataFrame; only the names of the columns to read come to the driver. Pairs
    that cannot reach the threshold go before values are compared, empty tables among them. Row counts
    that are at hand (``Estate.row_counts`` or a profile) spare reading the columns of empty tables.
    """
    frames = {k: s.rows for k, s in estate.sources.items()}
    catalog = rules.CatalogFrames.of(estate)
    positions = rules.composite_positions(catalog)
    parts = inclusion(frames, positions, empty_is_null=empty_is_null, at_least=threshold).filter(F.col("overlap") >= threshold)
    # one row per column that really holds values of a key's part: as many as there are references, not pairs
    fitting = settled(parts.select(positions.columns))
    found = all_candidates(estate, counts=counts, fitting=fitting, catalog=catalog)
    measured = inclusion(frames, found, empty_is_null=empty_is_null, at_least=threshold)
    return choose(measured, threshold=threshold)


def choose(measured: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """From measured candidates to relationships: thresholds, best parents, suppressions."""
    single = F.col("rule").isin("exact", "suffix")
    # A single column has one best parent per rule; a composite child one choice per parent key.
    per_child = W.partitionBy(
        "rule", "owner", "table",
        F.when(single, F.col("columns")),
        F.when(~single, F.struct("parent_owner", "parent_table", "parent_columns")),
    ).orderBy(F.desc("overlap"), "parent_order")
    best = (
        measured.filter(F.col("overlap") >= threshold)
        .withColumn("place", F.row_number().over(per_child)).filter("place = 1").drop("place")
    )
    best = without_mutual_keys(best)
    exact_match = F.max(F.col("rule") == "exact").over(W.partitionBy("owner", "table", "columns"))
    return described(best.withColumn("has_exact", exact_match).filter((F.col("rule") != "suffix") | ~F.col("has_exact")))


def without_mutual_keys(matches: DataFrame) -> DataFrame:
    """Drop both directions where two primary keys of the same name claim each other."""
    child = F.struct("owner", "table", "columns")
    parent = F.struct(
        F.col("parent_owner").alias("owner"), F.col("parent_table").alias("table"),
        F.col("parent_columns").alias("columns"),
    )
    key_pair = (F.col("rule") == "exact") & F.col("child_is_key") & F.col("parent_is_key")
    ends = W.partitionBy(F.least(child, parent), F.greatest(child, parent))
    both = F.count_if(key_pair).over(ends)
    return matches.withColumn("both", both).filter(~(key_pair & (F.col("both") > 1))).drop("both")


def offline(estate: Estate) -> DataFrame:
    """Name matches without looking at data: unambiguous exact names, and composite names; all low."""
    catalog = rules.CatalogFrames.of(estate)
    named = rules.unambiguous(rules.exact_name(catalog)).unionByName(rules.composite_exact(catalog))
    unmeasured = named.select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in zip(MEASURES, MEASURE_TYPES)]
    )
    return described(without_mutual_keys(unmeasured))


def _quoted_list(col: str) -> Column:
    return F.array_join(col, ", ")


def _evidence() -> Column:
    """Sentences that say why, and how much of the data agrees."""
    cross = F.when(F.col("parent_owner") != F.col("owner"), " (cross-schema)").otherwise("")
    same = (F.col("parent_owner") == F.col("owner")) & (F.col("parent_table") == F.col("table"))
    key = F.concat("parent_table", F.lit("."), F.col("parent_columns")[0])
    share = F.when(F.col("overlap").isNotNull(), percent(F.col("overlap")))
    named = F.format_string("Named like the key %s%s.", key, cross)
    other_type = F.when(
        base_type(F.col("child_type")) != F.col("parent_type"),
        F.format_string("Its type %s is not the key's %s.", "child_type", "parent_type"),
    )
    suffix = F.format_string(
        "Ends in %s and has the type of %s%s.", trailing_token(F.col("columns")[0]), key,
        F.when(same, " (self-reference)").otherwise(cross),
    )
    held = F.format_string("Holds all of the key (%s) of %s%s.", _quoted_list("parent_columns"), "parent_table", cross)
    renamed = F.array_join(
        F.filter(
            F.zip_with("columns", "parent_columns", lambda c, p: F.when(c != p, F.concat(c, F.lit("->"), p))),
            lambda x: x.isNotNull(),
        ), ", ",
    )
    roles = F.format_string("Matches the key of %s by suffix and type%s (%s).", "parent_table", cross, renamed)
    first = (
        F.when(F.col("rule") == "exact", named).when(F.col("rule") == "suffix", suffix)
        .when(F.col("rule") == "composite_exact", held).otherwise(roles)
    )
    single = F.col("rule").isin("exact", "suffix")
    kind = F.when(single, "values").otherwise("value tuples")
    measured = F.format_string("%s of the distinct %s are in the key.", share, kind)
    return F.array_compact(
        F.array(
            first,
            F.when(F.col("rule") == "exact", other_type),
            F.when(F.col("overlap").isNotNull(), measured),
        )
    )


def described(matches: DataFrame) -> DataFrame:
    return matches.withColumns({
        "declared": F.lit(False),
        "confidence": overlap_confidence(F.col("overlap")),
        "evidence": _evidence(),
        "cross_schema": F.col("owner") != F.col("parent_owner"),
    }).select(*RELATIONSHIP)


def declared(constraints: DataFrame) -> DataFrame:
    """Declared foreign keys as relationships; a target may belong to another owner."""
    unknown = F.lit(None)
    return constraints.filter("kind = 'R' AND ref_table IS NOT NULL").select(
        "owner", "table", "columns", F.coalesce("ref_owner", "owner").alias("parent_owner"),
        F.col("ref_table").alias("parent_table"), F.col("ref_columns").alias("parent_columns"),
        F.lit(True).alias("declared"), F.lit("declared").alias("rule"), F.lit(HIGH).alias("confidence"),
        F.array(F.format_string("Declared by constraint %s.", "name")).alias("evidence"),
        unknown.cast("double").alias("overlap"), unknown.cast("long").alias("orphan_rows"),
        (F.coalesce("ref_owner", "owner") != F.col("owner")).alias("cross_schema"),
    )


def relationships(estate: Estate, **which) -> DataFrame:
    """Declared references, with their overlap and orphans measured, and the undeclared ones that ``discover`` finds.

    Columns with a declared reference get no second one. A declared reference to a table outside the estate stays unmeasured.
    """
    pair = ["owner", "table", "columns", "parent_owner", "parent_table", "parent_columns"]
    stated = declared(estate.constraints())
    names = local_rows(estate.spark, estate.keys(), "parent_owner string, parent_table string")
    here = stated.join(names, ["parent_owner", "parent_table"], "left_semi").select(*pair).distinct()
    figures = inclusion({k: s.rows for k, s in estate.sources.items()}, here).select(*pair, "overlap", "orphan_rows")
    measured = stated.drop("overlap", "orphan_rows").join(figures, pair, "left")
    found = discover(estate, **which)
    return measured.select(*found.columns).unionByName(found)
