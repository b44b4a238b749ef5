"""A global position without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunefold import shared


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds each row's place (from 0) in the given order: range partitions, a number within each, and an offset per
    partition from the partitions' sizes. ``order`` should be unique for a stable result."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    kept = shared.materialise(ranged, "positions")
    sizes = sorted((r["__part"], r["count"]) for r in kept.groupBy("__part").count().collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts or [(-1, 0)], "__part int, __start long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return kept.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + place).drop("__part", "__start")
