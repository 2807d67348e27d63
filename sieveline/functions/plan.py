"""Shaping the logical plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns whose results later expressions use as they are.

    The optimizer moves filters below projections by putting the projected expressions in the place of columns. A chain
    of steps, each of which uses the one before several times, would grow exponentially. A generator of one row stops this.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[x.alias(c) for c, x in columns.items()]))))


#: Bytes that one split of a large table has.
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores if it is too small for a split a core: a file of one row group is read by one task, whatever
    its splits. Tables of more than that are read by enough tasks and pass unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPLIT * cores else df
