"""Positions and running totals of whole tables, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace, at_most

PART_ROWS = 200_000
BLOCK = 4096
BROADCAST_PARTS = 100_000


def positions(work: Workspace, df: DataFrame, group: str, order: list, name: str = "position",
              part_rows: int = PART_ROWS) -> DataFrame:
    """Add the 0-based position of each row among the rows of its ``group`` (a column without nulls) in ``order``.

    Rows are dealt by ranges of (group, order), so a group that holds most rows spans partitions; a row's position
    is its place in the partition plus the rows of its group in earlier ones. Rows equal in ``order`` are in any order.
    """
    ranges = max(1, -(-df.count() // part_rows))
    dealt = df.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = work.save(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", row), "ranges")
    parts = work.save(rows.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")), "parts")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_add"))
    side = F.broadcast(offsets) if at_most(parts, BROADCAST_PARTS) else offsets
    return rows.join(side, [group, "_part"]).withColumn(name, F.col("_row") + F.col("_add")).drop("_part", "_row", "_add")


def running_totals(df: DataFrame, number: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows with a smaller ``number``, a distinct non-negative long.

    Totals of blocks of ``BLOCK`` numbers are summed first, so no task holds more rows than one block or all blocks.
    """
    block = (F.col(number) / BLOCK).cast("long")
    blocks = df.groupBy(block.alias("_block")).agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_block", block).join(blocks, "_block").withColumn(
        name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_block", "_base")
