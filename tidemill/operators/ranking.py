"""Places in a total order and running sums, without a window over all rows or over a section.

Rows are dealt out by ranges and sorted in each. The sorted table is written once with each row's place in
its range, so what is counted and what is numbered are the same rows, also when an executor is lost. Then
only one row per range and section is summed up, and meets the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: monotonically_increasing_id() has the partition above these bits and the row in it below.
ROW_BITS = 33


def in_ranges(rows: DataFrame, order: list[Column], name: str = "ranges") -> DataFrame:
    """rows, sorted over range partitions and written, with __part and __at (a row's place in its range, from 0).

    Rows that tie in order may be parted anywhere; so that a hot tie doesn't meet in one range, order should end
    with a column that tells rows apart.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    held = staged(dealt, name)
    return held.withColumns({"__part": F.shiftright("__id", ROW_BITS), "__at": F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)}).drop("__id")


def numbered(rows: DataFrame, order: list[Column], section: list[str] | None = None, name: str = "n", size: str | None = None, first: int = 1) -> DataFrame:
    """rows with their number in order (a long, from first) within their section; size: a column for the section's rows.

    section: column names, null a value of its own; none: all rows are one. Windows see a row per range
    partition and section in it, at most one more than partitions and sections together.
    """
    section = section or []
    held = in_ranges(rows, [*(F.col(c).asc_nulls_first() for c in section), *order], "numbered")
    runs = held.groupBy(*section, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    own = Window.partitionBy(*section) if section else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.struct(*section, "__part").alias("__key"), (before - F.col("__first")).alias("__add"), F.sum("__n").over(own).alias("__size"))
    both = held.withColumn("__own", F.struct(*section, "__part")).join(staged(runs, "runs"), F.col("__own").eqNullSafe(F.col("__key")))
    out = both.withColumn(name, F.col("__at") + F.col("__add") + first)
    return (out if size is None else out.withColumn(size, F.col("__size"))).drop("__part", "__at", "__own", "__key", "__add", "__size")
