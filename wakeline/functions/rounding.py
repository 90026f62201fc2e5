"""Rounding to decimals, half to even on the scaled binary value (0.125 → 0.12, 2.675 → 2.67)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column | str, digits: int = 0) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    # Through an integer, so that a negative zero cannot appear.
    return F.rint(c * scale).cast("bigint") / F.lit(scale)
