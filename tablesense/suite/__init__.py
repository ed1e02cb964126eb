"""The registered queries over the given tables, each next to the SQL that checks it."""

from tablesense.suite import analysis, batch, catalogs, fk, logs, profiling, retrieval  # noqa: F401
from tablesense.suite.registry import REGISTRY

__all__ = ["REGISTRY"]
