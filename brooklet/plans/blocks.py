"""Overlap blocks: a sliding window over one long stream, cut into independent parts.

`OVER (ORDER BY idx ROWS n - 1 PRECEDING)` without a key runs in one task. Instead,
every row goes to the block of its place, and to the next one if the windows of that
block's first rows still see it. Frames then run per block, and each block keeps its
own rows. This is exact, at 1 + window / block copies of a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(window: float) -> int:
    """Rows that a window of the default clock holds, the current one included."""
    if not window > 0:
        raise ValueError("window must be positive")
    return math.ceil(window)


def overlap(df: DataFrame, place: Column, reach, size) -> DataFrame:
    """df with `blk` and `home`: each row in its own block (home) and in the later block
    that reaches back to it. reach: how far a window looks back; size >= reach."""
    own = F.floor(place / F.lit(size)).cast("long")
    far = F.floor((place + F.lit(reach)) / F.lit(size)).cast("long")
    both = F.array_distinct(F.array(own, far))
    return df.withColumn("__own", own).withColumn("blk", F.explode(both)).withColumn("home", F.col("blk") == F.col("__own")).drop("__own")


def by_rows(df: DataFrame, n: int, factor: int = 8, least: int = 2048) -> DataFrame:
    """Overlap blocks for a window of n rows over idx."""
    return overlap(df, F.col("idx"), n - 1, max(factor * n, least))


def by_time(df: DataFrame, window, factor: int = 8) -> DataFrame:
    """Overlap blocks for a window of that length over t."""
    return overlap(df, F.col("t"), window, factor * window)
