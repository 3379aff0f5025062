"""Places in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.shared import stored


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, from 0: they are sorted in ranges and written, and ranges are counted; ties are ranked in any order."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = stored(ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


#: Rows that a task makes of a join, about, and the most tasks.
MADE, MOST_TASKS = 500_000, 4096


def tasks_for(rows) -> int:
    """So many tasks make so many rows of a join. Few bytes can make very many rows, which Spark, going by bytes, would leave to one task."""
    return max(1, min(MOST_TASKS, -(-int(rows or 0) // MADE)))
