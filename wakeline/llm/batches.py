"""Sizes of the batches that Spark hands to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BYTES, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = 4_000_000


def bound(spark: SparkSession) -> None:
    """Smaller batches than by default, whatever the number of rows: long texts would fill a worker. A size that the
    session names itself stays."""
    if spark.conf.get(BYTES) == DEFAULT:
        spark.conf.set(BYTES, str(BATCH_BYTES))
