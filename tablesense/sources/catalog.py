"""Catalog frames: tables, columns and constraints of an estate of tables.

A catalog is small (one row per column), so its frames are local relations and its joins
broadcast by size. Only the measured facts (row counts, profiles, overlaps) touch the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesense.sources.tables import local_rows, united

TABLE_SCHEMA = "owner string, table string, comment string, num_rows long"
COLUMN_SCHEMA = (
    "owner string, table string, ordinal int, column string, data_type string, length int, "
    "precision int, scale int, nullable boolean, comment string"
)
CONSTRAINT_SCHEMA = (
    "owner string, table string, name string, kind string, columns array<string>, "
    "ref_owner string, ref_table string, ref_columns array<string>"
)
# Schemas that belong to the database itself, and the prefixes of such schemas.
SYSTEM_OWNERS = (
    "SYS SYSTEM XDB MDSYS CTXSYS DBSNMP OUTLN GSMADMIN_INTERNAL LBACSYS DVSYS DVF AUDSYS "
    "APPQOSSYS OJVMSYS ORDSYS ORDDATA ORDPLUGINS SI_INFORMTN_SCHEMA WMSYS OLAPSYS "
    "REMOTE_SCHEDULER_AGENT ANONYMOUS GGSYS SYSBACKUP SYSDG SYSKM SYSRAC SYS$UMF PDBADMIN "
    "FLOWS_FILES APEX_PUBLIC_USER DIP ORACLE_OCM XS$NULL"
).split()
SYSTEM_PREFIXES = ("APEX_", "FLOWS_")

# Scalar types that are aggregated and sampled; large objects and nested types are not.
PROFILABLE_PREFIXES = (
    "NUMBER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE", "VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR",
    "DATE", "TIMESTAMP",
)


def type_name(data_type: T.DataType) -> tuple[str, int | None, int | None]:
    """A Spark type as (catalog type name, precision, scale)."""
    if isinstance(data_type, T.DecimalType):
        return "NUMBER", data_type.precision, data_type.scale
    names: list[tuple[type, str, int | None]] = [
        (T.ByteType, "NUMBER", 3), (T.ShortType, "NUMBER", 5), (T.IntegerType, "NUMBER", 10),
        (T.LongType, "NUMBER", 19), (T.FloatType, "BINARY_FLOAT", None),
        (T.DoubleType, "BINARY_DOUBLE", None), (T.StringType, "VARCHAR2", None),
        (T.DateType, "DATE", None), (T.TimestampNTZType, "TIMESTAMP", None),
        (T.TimestampType, "TIMESTAMP WITH TIME ZONE", None), (T.BinaryType, "RAW", None),
    ]
    for spark_type, name, precision in names:
        if isinstance(data_type, spark_type):
            return name, precision, 0 if name == "NUMBER" else None
    return data_type.simpleString().upper(), None, None


@dataclass(frozen=True)
class Source:
    """One table of an estate: its rows, and what is known about it beforehand."""

    rows: DataFrame
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    # (columns, referenced owner, referenced table, referenced columns)
    foreign_keys: tuple[tuple[tuple[str, ...], str, str, tuple[str, ...]], ...] = ()
    comment: str | None = None
    column_comments: Mapping[str, str] = field(default_factory=dict)
    large_text: tuple[str, ...] = ()  # text columns of any length, as CLOB
    lengths: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Estate:
    """Tables by (owner, name), kept in catalog order: owners as given, tables by name."""

    spark: SparkSession
    sources: Mapping[tuple[str, str], Source]

    def only(self, owners: Iterable[str] | str = "*") -> "Estate":
        """The tables of one owner, of several, or of all ('*')."""
        wanted = None if owners == "*" else {owners} if isinstance(owners, str) else set(owners)
        kept = [k for k in self.keys() if wanted is None or k[0] in wanted]
        return Estate(self.spark, {k: self.sources[k] for k in kept})

    def keys(self) -> list[tuple[str, str]]:
        owners = list(dict.fromkeys(owner for owner, _ in self.sources))
        return sorted(self.sources, key=lambda k: (owners.index(k[0]), k[1]))

    def tables(self) -> DataFrame:
        rows = [(o, t, self.sources[o, t].comment, None) for o, t in self.keys()]
        return local_rows(self.spark, rows, TABLE_SCHEMA)

    def column_rows(self) -> list[tuple]:
        rows = []
        for owner, table in self.keys():
            src = self.sources[owner, table]
            for i, f in enumerate(src.rows.schema.fields, start=1):
                name, precision, scale = type_name(f.dataType)
                if f.name in src.large_text:
                    name = "CLOB"
                rows.append((
                    owner, table, i, f.name, name, src.lengths.get(f.name), precision, scale,
                    f.nullable, src.column_comments.get(f.name),
                ))
        return rows

    def columns(self) -> DataFrame:
        return local_rows(self.spark, self.column_rows(), COLUMN_SCHEMA)

    def constraints(self) -> DataFrame:
        rows = []
        for owner, table in self.keys():
            src = self.sources[owner, table]
            keys = [("P", src.primary_key)] if src.primary_key else []
            keys += [("U", u) for u in src.unique_keys]
            for i, (kind, cols) in enumerate(keys):
                name = f"{kind}K_{table}_{i}".upper()
                rows.append((owner, table, name, kind, list(cols), None, None, None))
            for i, (cols, ref_owner, ref_table, ref_cols) in enumerate(src.foreign_keys):
                name = f"FK_{table}_{i}".upper()
                rows.append(
                    (owner, table, name, "R", list(cols), ref_owner, ref_table, list(ref_cols))
                )
        return local_rows(self.spark, rows, CONSTRAINT_SCHEMA)

    def row_counts(self) -> DataFrame:
        """(owner, table, num_rows), counted; column-less scans, so parquet footers answer."""
        counts = [
            self.sources[o, t].rows.groupBy().agg(F.count(F.lit(1)).alias("num_rows"))
            .select(F.lit(o).alias("owner"), F.lit(t).alias("table"), "num_rows")
            for o, t in self.keys()
        ]
        return united(counts)


def profilable(data_type: Column) -> Column:
    upper = F.upper(data_type)
    return reduce(lambda a, b: a | b, [F.startswith(upper, F.lit(p)) for p in PROFILABLE_PREFIXES])


def profilable_columns(estate: Estate, owner: str, table: str) -> list[str]:
    """Columns of a table that are measured: scalars, but no large objects or nested values."""
    return [
        r[3] for r in estate.column_rows()
        if r[:2] == (owner, table) and r[4].startswith(PROFILABLE_PREFIXES)
    ]


def merge_catalogs(catalogs: Mapping[str, DataFrame]) -> DataFrame:
    """Per-owner catalog frames as one, each row tagged with its owner."""
    tagged = [df.withColumn("owner", F.lit(owner)) for owner, df in catalogs.items()]
    return united(tagged)


def resolve_constraints(constraints: DataFrame, constraint_columns: DataFrame) -> DataFrame:
    """Constraints with their columns in position order and, for foreign keys, what they reference.

    ``constraints``: owner, name, table, kind, ref_owner, ref_name; ``constraint_columns``: owner,
    name, column, position. A reference may point into another owner.
    """
    ordered = F.sort_array(F.collect_list(F.struct("position", "column")))
    columns = constraint_columns.groupBy("owner", "name").agg(
        F.transform(ordered, lambda c: c["column"]).alias("columns")
    )
    full = constraints.filter(F.col("kind").isin("P", "R", "U", "C")).join(
        columns, ["owner", "name"], "left"
    )
    referenced = full.select(
        F.col("owner").alias("ref_owner"),
        F.col("name").alias("ref_name"),
        F.col("table").alias("ref_table"),
        F.col("columns").alias("ref_columns"),
    )
    return full.join(referenced, ["ref_owner", "ref_name"], "left").select(
        "owner", "table", "name", "kind", "columns", "ref_owner", "ref_table", "ref_columns"
    )


def application_owners(tables: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Owners that are not the database's own and own a table.

    ``users`` (owner, maintained 'Y'/'N') decides when given; otherwise a fixed list does.
    """
    if users is not None:
        return (
            users.filter(F.col("maintained") == "N").select("owner")
            .join(tables.select("owner"), "owner", "left_semi")
        )
    prefixed = reduce(
        lambda a, b: a | b, [F.startswith("owner", F.lit(p)) for p in SYSTEM_PREFIXES]
    )
    return (
        tables.select("owner").filter(~F.col("owner").isin(*SYSTEM_OWNERS) & ~prefixed).distinct()
    )


def ground_truth(tables: DataFrame, columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """What is documented now: per table its comment, column comments and declared foreign keys."""
    key = ["owner", "table"]
    commented = columns.filter(F.trim("comment") != "").groupBy(*key).agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(F.collect_list(F.struct("ordinal", "column", "comment"))),
                lambda c: F.struct(c["column"], c["comment"]),
            )
        ).alias("column_comments")
    )
    foreign = constraints.filter((F.col("kind") == "R") & F.col("ref_table").isNotNull())
    declared = foreign.groupBy(*key).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("columns").alias("from_columns"),
                    F.col("ref_table").alias("to_table"),
                    F.col("ref_columns").alias("to_columns"),
                )
            )
        ).alias("foreign_keys")
    )
    comment = F.trim("comment")
    return (
        tables.select(*key, F.when(comment != "", comment).alias("comment"))
        .join(commented, key, "left").join(declared, key, "left")
    )


def columns_named(columns: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Which tables have a column of these names."""
    return columns.filter(F.upper("column").isin(*[w.upper() for w in wanted]))
