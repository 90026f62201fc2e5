"""Vectors of a table, checked and packed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_id: str, embedding: str, *others: str) -> DataFrame:
    """``id``, ``x`` (doubles) and the other columns of rows whose vector takes part: it is not null, empty or
    zero and holds no null or non-finite component."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    return df.select(F.col(vec_id).cast("long").alias("id"), x.alias("x"), *others).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(good)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists all have one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)
