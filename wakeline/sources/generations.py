"""Which folders make up a stored table, kept as numbered generations.

A generation is a small JSON text in ``<folder>/_generations/<number>``. It is written by Spark's text writer, so it
counts from the moment its ``_SUCCESS`` file is there: readers see the old table or the new one, never a mixture, and a
job that dies before leaves only folders that nothing names. Two writers of one number: the second one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

_POINTERS = "_generations"


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system Spark can read; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def is_complete(spark: SparkSession, folder: str) -> bool:
    return "_SUCCESS" in children(spark, folder)


def newest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest generation; 0 and nothing where there is none."""
    for name in reversed(children(spark, f"{folder}/{_POINTERS}")):
        pointer = f"{folder}/{_POINTERS}/{name}"
        if is_complete(spark, pointer):
            return int(name), json.loads(spark.read.text(pointer, wholetext=True).first()[0])
    return 0, {}


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make ``content`` generation ``number``. A pointer that a dead job left unfinished is replaced."""
    pointer = f"{folder}/{_POINTERS}/{number:012d}"
    if is_complete(spark, pointer):
        raise RuntimeError(f"generation {number} of {folder} was written by another job")
    text = json.dumps(content, sort_keys=True).replace("'", "''")
    spark.sql(f"SELECT r'{text}' AS value").coalesce(1).write.mode("overwrite").text(pointer)
