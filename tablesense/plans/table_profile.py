"""Profiles of every table of an estate, as one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablesense.operators.profile import estate_value_counts, profile_counts
from tablesense.sources.catalog import PROFILABLE_PREFIXES, Estate
from tablesense.sources.tables import local_rows


def profile_estate(estate: Estate, *, samples: bool = True) -> DataFrame:
    """(owner, table, column, ...) for all scalar columns; large texts and nested values are left out."""
    wanted = [r for r in estate.column_rows() if r[4].startswith(PROFILABLE_PREFIXES)]
    labels = [(i, owner, table, column) for i, (owner, table, _, column, *_) in enumerate(wanted)]
    numbers: dict[tuple[str, str], dict[str, int]] = {}
    for i, owner, table, column in labels:
        numbers.setdefault((owner, table), {})[column] = i
    counts = estate_value_counts([(estate.sources[k].rows, n) for k, n in numbers.items()])
    names = local_rows(estate.spark, labels, "column int, owner string, table string, name string")
    return profile_counts(counts, names, samples=samples).drop("column").withColumnRenamed("name", "column")
