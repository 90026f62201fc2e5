"""Session helpers: SQL settings, the shared folder, size checks and inline tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC; the only session setting the operators rely on."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a local one where it is unset."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="wakeline-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """Compute ``df`` once: write it to the shared folder and read it back.

    For results several later steps use. It cuts the lineage, survives lost executors, and the file sizes
    let Spark choose join strategies.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Workspace:
    """Owner of the tables one computation writes to the shared folder.

    ``save`` computes a table once and reads it back, ``drop`` removes one that nothing reads any more. Used as
    a context manager it removes the whole folder at the end; leave it open while a result still reads from it.
    """

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark, self.folder, self._n = spark, scratch_path(spark, name), 0

    def path(self, name: str) -> str:
        self._n += 1
        return os.path.join(self.folder, f"{self._n}-{name}")

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._workspace_path)

    def close(self) -> None:
        remove(self.spark, self.folder)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, without counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table of constants. It becomes a local relation with an exact size, so Spark broadcasts it."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
