"""How much of a child column is contained in a parent key, for one pair or a whole estate.

Overlap counts distinct child values; orphans count child rows. A child without any value has no
overlap and yields no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablesense.functions.keys import key_text, tuple_key
from tablesense.sources.tables import local_rows, united

MEASURES = ["distinct_total", "matched", "overlap", "orphan_rows"]
MEASURE_TYPES = ["long", "long", "double", "long"]
CHILD_KEY = ["owner", "table", "columns"]
PARENT_KEY = ["parent_owner", "parent_table", "parent_columns"]


def _key(df: DataFrame, columns: Sequence[str], empty_is_null: bool, numeric: bool) -> Column:
    if numeric:
        return F.col(f"`{columns[0]}`").cast("bigint")
    return tuple_key(
        [key_text(F.col(f"`{c}`"), df.schema[c].dataType, empty_is_null=empty_is_null) for c in columns]
    )


def _both_numeric(child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> bool:
    """Two single whole-number columns compare the same as numbers and as text, and cheaper."""
    return _whole_number(child, child_columns) and _whole_number(parent, parent_columns)


def _measure() -> list[Column]:
    found = F.col("in_parent")
    return [
        F.count(F.lit(1)).alias("distinct_total"),
        F.count_if(found).alias("matched"),
        F.coalesce(F.sum(F.when(~found, F.col("n_rows"))), F.lit(0)).alias("orphan_rows"),
    ]


def _with_overlap(df: DataFrame) -> DataFrame:
    ratio = F.col("matched") / F.col("distinct_total")
    return df.filter("distinct_total > 0").withColumn("overlap", ratio)


def overlap(
    child: DataFrame,
    child_columns: Sequence[str],
    parent: DataFrame,
    parent_columns: Sequence[str],
    *,
    empty_is_null: bool = False,
) -> DataFrame:
    """Distinct overlap and orphan rows of one (possibly composite) key pair, in one row.

    Child rows collapse to (key, n_rows) before the join, so a value that fills a third of the
    table travels once per map task, and overlap and orphans come from the same join.
    """
    numeric = _both_numeric(child, child_columns, parent, parent_columns)
    keyed = child.select(_key(child, child_columns, empty_is_null, numeric).alias("key"))
    values = keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    parents = parent.select(_key(parent, parent_columns, empty_is_null, numeric).alias("key")).distinct()
    joined = values.join(parents.withColumn("hit", F.lit(True)), "key", "left")
    found = joined.withColumn("in_parent", F.col("hit").isNotNull())
    return _with_overlap(found.agg(*_measure())).select(*MEASURES)


def orphan_rows(
    child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """The child rows themselves whose complete key has no parent."""
    numeric = _both_numeric(child, child_columns, parent, parent_columns)
    keyed = child.withColumn("__key", _key(child, child_columns, False, numeric))
    parents = parent.select(_key(parent, parent_columns, False, numeric).alias("__key"))
    return keyed.filter(F.col("__key").isNotNull()).join(parents, "__key", "left_anti").drop("__key")


def inclusion(
    tables: Mapping[tuple[str, str], DataFrame],
    candidates: DataFrame,
    *,
    empty_is_null: bool = False,
    at_least: float | None = None,
) -> DataFrame:
    """Measure every candidate pair of an estate in one job.

    ``candidates``: owner, table, columns (child) and parent_owner, parent_table, parent_columns,
    with any further columns, which are kept. Only the keys themselves come to the driver, since they
    say which columns to read; pairs stay a DataFrame.

    Every column is read once, whatever it is to others, and its values are counted. A value then has
    one row with the set of parent keys that hold it, its signature, and the children that do. Values
    of a child are counted by signature before any pair is formed: columns of dense ids have about as
    many signatures as there are parents of different size, however many values they hold. A pair adds
    up the signatures that name its parent. No step lists the pairs of columns that share a value.

    With ``at_least``, only pairs of that overlap or more are returned.
    """
    child_ids, parent_ids = _keys(candidates, CHILD_KEY), _keys(candidates, PARENT_KEY)
    if not child_ids:
        unmeasured = [F.lit(None).cast(t).alias(c) for c, t in zip(MEASURES, MEASURE_TYPES)]
        return candidates.limit(0).select("*", *unmeasured)
    ids = _numbered([*child_ids, *parent_ids])
    whole = {key: _whole_number(tables[key[:2]], key[2]) for key in ids}
    numbered = candidates
    for names, end, keys in ((CHILD_KEY, "child", child_ids), (PARENT_KEY, "parent", parent_ids)):
        rows = [(*k, ids[k], whole[k]) for k in keys]
        schema = f"{names[0]} string, {names[1]} string, {names[2]} array<string>, {end}_id int, {end}_whole boolean"
        numbered = numbered.join(local_rows(candidates.sparkSession, rows, schema), names)
    numbered = numbered.withColumn("numeric", F.col("child_whole") & F.col("parent_whole")).drop("child_whole", "parent_whole")
    pairs = numbered.select("numeric", "child_id", "parent_id").distinct()
    # which columns are compared as numbers and which as text; a column may be both
    roles = pairs.select("numeric", F.inline(F.array(
        F.struct(F.col("child_id").alias("id"), F.lit(True).alias("child")), F.struct(F.col("parent_id").alias("id"), F.lit(False).alias("child")),
    ))).distinct().collect()
    keys = {number: key for key, number in ids.items()}
    values = united([
        _melt(tables, {keys[i]: i for i in sorted({r["id"] for r in roles if r["numeric"] == kind})}, empty_is_null, kind)
        .groupBy("key_id", "key").agg(F.count(F.lit(1)).alias("n_rows"))
        .groupBy("key").agg(
            F.collect_list(F.when(_among({r["id"] for r in roles if r["numeric"] == kind and not r["child"]}), F.col("key_id"))).alias("holders"),
            F.collect_list(F.when(_among({r["id"] for r in roles if r["numeric"] == kind and r["child"]}), F.struct("key_id", "n_rows"))).alias("children"),
        )
        .select(F.lit(kind).alias("numeric"), F.array_sort("holders").alias("holders"), "children")
        for kind in sorted({r["numeric"] for r in roles})
    ])
    measured = _measured(values, pairs)
    if at_least is not None:
        measured = measured.filter(F.col("matched") >= F.col("distinct_total") * at_least * (1 - 1e-9))
    labelled = numbered.join(measured, ["numeric", "child_id", "parent_id"])
    return _with_overlap(labelled).select(*candidates.columns, *MEASURES)


def _among(numbers: set[int]) -> Column:
    return F.col("key_id").isin(sorted(numbers))


def _measured(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(numeric, child_id, parent_id) of ``pairs`` with their measures, from (numeric, holders, children) of each value."""
    signature = F.struct(F.xxhash64("holders").alias("s"), F.xxhash64(F.reverse("holders"), F.lit(1)).alias("t"), F.size("holders").alias("n"))
    counted = (
        values.select("numeric", signature.alias("signature"), F.inline("children"))
        .groupBy("numeric", F.col("key_id").alias("child_id"), "signature")
        .agg(F.count(F.lit(1)).alias("values"), F.sum("n_rows").alias("rows"))
    )
    holding = (
        values.select("numeric", "holders").distinct()
        .select("numeric", signature.alias("signature"), F.explode("holders").alias("parent_id"), F.lit(True).alias("held"))
    )
    met = counted.join(pairs, ["numeric", "child_id"]).join(holding, ["numeric", "signature", "parent_id"], "left")
    inside = F.col("held").isNotNull()
    return met.groupBy("numeric", "child_id", "parent_id").agg(
        F.sum("values").alias("distinct_total"),
        F.coalesce(F.sum(F.when(inside, F.col("values"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(~inside, F.col("rows"))), F.lit(0)).alias("orphan_rows"),
    )


def _keys(candidates: DataFrame, names: Sequence[str]) -> list[tuple]:
    return sorted(_frozen(r) for r in candidates.select(*names).distinct().collect())


def _whole_number(df: DataFrame, columns: Sequence[str]) -> bool:
    return len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.IntegralType)


def _frozen(row: Sequence) -> tuple:
    return tuple(tuple(v) if isinstance(v, list) else v for v in row)


def _numbered(keys: Iterable[tuple]) -> dict[tuple, int]:
    return {key: i for i, key in enumerate(dict.fromkeys(keys))}


def _melt(
    tables: Mapping[tuple[str, str], DataFrame], ids: Mapping[tuple, int], empty_is_null: bool, numeric: bool
) -> DataFrame:
    """(key_id, key) for all wanted keys, one pass over each table."""
    by_table: dict[tuple[str, str], list[tuple[tuple, int]]] = {}
    for (owner, table, columns), number in ids.items():
        by_table.setdefault((owner, table), []).append((columns, number))
    melted = []
    for where, keys in by_table.items():
        df = tables[where]
        cells = [
            F.struct(F.lit(number).alias("key_id"), _key(df, cols, empty_is_null, numeric).alias("key"))
            for cols, number in keys
        ]
        melted.append(df.select(F.inline(F.array(*cells))).filter(F.col("key").isNotNull()))
    return united(melted)
