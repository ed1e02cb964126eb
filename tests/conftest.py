import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablesense.session import get_session  # noqa: E402
from tablesense.sources.catalog import Estate, Source  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Rows and a DDL schema to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def estate(spark, make):
    """{(owner, table): (rows, schema, Source options)} to an estate."""

    def build(tables):
        return Estate(spark, {k: Source(make(rows, schema), **options) for k, (rows, schema, options) in tables.items()})

    return build
