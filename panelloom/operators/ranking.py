"""Positions in a total order, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.sources.storage import store

_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place within its partition


def with_position(frame: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """frame with each row's 0-based place in the order.

    Rows are dealt out by ranges of the order and sorted within; a window over the counts of
    these ranges, one row each, gives their offsets. No task sorts more than a range. The order
    must tell rows apart, else ties are numbered as they come.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = store(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges").withColumn(
        "__range", F.shiftright("__at", _PLACE_BITS)
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    place = F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("__offset")
    # as many offsets as ranges, at most spark.sql.shuffle.partitions
    numbered = stored.join(F.broadcast(offsets), "__range").withColumn(name, place)
    return numbered.drop("__at", "__range", "__offset")
