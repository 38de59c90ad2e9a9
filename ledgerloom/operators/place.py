"""Row numbers of a whole ordered result, without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cleared, discard, settled


def with_place(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, each row's number from 1 in the order of ``order``; rows that tie go in any order.

    Rows are kept as they come, so that what made them is off the disk when they are sorted and isn't worked out again to
    find the ranges. They are sorted over ranges and kept again; a range's first number is what the ranges before it
    hold. Only those counts, one a range, reach the driver.
    """
    rows = settled(df, "to-place")
    ranged = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    held = settled(ranged, "placed")
    discard(rows)
    with cleared(df.sparkSession):
        sizes = {r["_part"]: r["n"] for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    firsts, before = [], 0
    for part in sorted(sizes):
        firsts.append((part, before))
        before += sizes[part]
    starts = df.sparkSession.createDataFrame(firsts, "_part int, _before long")
    return held.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")
