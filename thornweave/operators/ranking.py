"""Global ranks without a window over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with the row's place in the order, from 0. The columns of the order have to tell rows apart.

    Rows are sorted in ranges; a row's place in its range is in its generated id, and the ranges' sizes (one row for each)
    are added up.
    """
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ids = materialise(ids, "ranked")
    part = F.shiftright("_place", 33)
    sizes = sorted(ids.groupBy(part.alias("part")).count().collect())  # one row for each partition
    starts, total = [], 0
    for row in sizes:
        starts.append((row.part, total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    ranked = ids.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.select(*df.columns, (F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
