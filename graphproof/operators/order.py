"""Positions in a total order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphproof.session import Scratch

_ROW_BITS = 33  # of a number of monotonically_increasing_id: the place within its partition


def with_position(df: DataFrame, keys: Sequence[str | Column], scratch: Scratch, name: str = "ordered") -> DataFrame:
    """``df`` with ``position`` (from 1) in the order of ``keys``, nulls first.

    Rows are range-partitioned and sorted, numbered within their partitions and written once, so numbers are fixed whatever
    is run again. A partition's offset is the sum of the counts before it; there is one count per partition. Rows with
    equal keys are next to one another, in an order that is fixed but not told.
    """
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = scratch.write(laid.withColumn("_number", F.monotonically_increasing_id()), name)
    part = F.shiftright("_number", _ROW_BITS)
    before, offsets = 0, []
    for row in sorted(laid.groupBy(part.alias("part")).count().collect()):  # as many rows as partitions
        offsets.append((row["part"], before))
        before += row["count"]
    offset = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    within = F.col("_number").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = laid.join(F.broadcast(offset), part == F.col("_part"))
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (within + F.col("_before") + 1).alias("position"))
