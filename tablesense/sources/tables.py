"""Read-only table sources."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read_parquet(
    spark: SparkSession,
    path: str,
    *,
    columns: Sequence[str] | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """A parquet table; the filter and the column list both reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A table or SELECT of a live database, read in parallel ranges of ``partition_column``.

    Dictionary views (columns, constraints, source lines) are read the same way.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) src", **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Catalog-sized rows as a local relation, whose known size lets joins broadcast it safely."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)


def settled(catalog_frame: DataFrame) -> DataFrame:
    """Run a frame of tables, columns or constraints once and keep its rows as a local relation.

    Only for frames with one row per table, column or constraint; never for data or for pairs of columns.
    """
    rows = [tuple(r) for r in catalog_frame.collect()]
    return local_rows(catalog_frame.sparkSession, rows, catalog_frame.schema)


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of all frames, matched by name.

    Joined two by two, so that a union of thousands of tables is analysed in n log n, not n squared.
    """
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]


def row_page(df: DataFrame, max_rows: int) -> tuple[list[dict], bool]:
    """At most ``max_rows`` rows for a person to read, and whether the bound was reached."""
    rows = df.limit(max(1, max_rows)).collect()
    return [r.asDict() for r in rows], len(rows) >= max_rows


def capped(df: DataFrame, max_rows: int) -> DataFrame:
    """(capped): whether a page of ``max_rows`` would be full; reads no more than that."""
    return df.limit(max_rows).agg((F.count(F.lit(1)) >= max_rows).alias("capped"))
