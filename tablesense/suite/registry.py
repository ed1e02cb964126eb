"""Registration of queries: a function of (spark, data directory) and its checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None
    covers: str  # the inventory rows it stands for


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if run.__name__ in REGISTRY:
            raise ValueError(f"query {run.__name__} is registered twice")
        REGISTRY[run.__name__] = Query(run, sql, covers)
        return run

    return register
