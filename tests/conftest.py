import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paperloom.queries.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(4)


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named string values."""
    from pyspark.sql import functions as F

    def value(expression, **columns):
        row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in columns.items()] or ["id"])
        return row.select(expression.alias("value")).first().value

    return value
