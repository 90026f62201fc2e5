import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from check_queries import session  # noqa: E402

# Started here because test modules build Column expressions when they are imported.
_SPARK = session(4)
_SPARK.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="session")
def spark():
    yield _SPARK
    _SPARK.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate an expression over one row of values."""

    def run(expr, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return df.select(expr.alias("x")).first()["x"]

    return run
