"""Stored tables that are merged bucket by bucket.

Rows are dealt to a fixed number of folders by a hash of their key. A merge reads and rewrites only the buckets that
incoming rows fall into, into new folders, and then publishes a generation that names the old folders of all other
buckets and the new ones. Files of untouched buckets keep their names; a merge that is run again gives the same table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import upsert
from . import generations

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(key: list[str], buckets: int) -> Column:
    """Bucket of a row: the first seven hex digits of an MD5 over the key, modulo ``buckets``."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % buckets).cast("int")


def _write(rows: DataFrame, folder: str, number: int, content: dict) -> None:
    spark, name = rows.sparkSession, f"generation-{number:012d}"
    dealt = rows.withColumn("bucket", bucket_of(content["key"], content["buckets"])).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
    written = [n.split("=")[1] for n in generations.children(spark, f"{folder}/{name}") if n.startswith("bucket=")]
    content = content | {"folders": content["folders"] | {b: name for b in written}, "schema": rows.schema.json()}
    generations.publish(spark, folder, number, content)


def create(rows: DataFrame, folder: str, key: tuple[str, ...] = upsert.COMMENT_KEY, buckets: int = 256) -> None:
    """Store ``rows``, whose keys are distinct, as a new table."""
    _write(rows, folder, 1, {"key": list(key), "buckets": buckets, "folders": {}})


def _read(spark: SparkSession, folder: str, content: dict, only: set[str] | None = None) -> DataFrame:
    paths = [f"{folder}/{name}/bucket={b}" for b, name in content["folders"].items() if only is None or b in only]
    schema = StructType.fromJson(json.loads(content["schema"]))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The newest generation of a stored table."""
    number, content = generations.newest(spark, folder)
    if not number:
        raise FileNotFoundError(f"no stored table in {folder}")
    return _read(spark, folder, content)


def layout(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folder of each bucket that has rows."""
    return {int(b): f"{folder}/{name}/bucket={b}" for b, name in generations.newest(spark, folder)[1]["folders"].items()}


def merge(incoming: DataFrame, folder: str, how: Merge = upsert.set_fields) -> None:
    """Merge ``incoming`` into a stored table by ``how(stored, incoming)``, bucket by bucket."""
    spark = incoming.sparkSession
    number, content = generations.newest(spark, folder)
    if not number:
        raise FileNotFoundError(f"no stored table in {folder}")
    of = bucket_of(content["key"], content["buckets"]).cast("string").alias("b")
    touched = {r["b"] for r in incoming.select(of).distinct().collect()}  # as many as there are buckets, at most
    if touched:
        _write(how(_read(spark, folder, content, touched), incoming), folder, number + 1, content)
