"""Semantic ids for songs that arrive as a stream, under a fitted hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tunefold import shared
from tunefold.config import HierarchyConfig
from tunefold.operators.clustering import predict


def score_available(stream: DataFrame, centers: DataFrame, allowed: DataFrame, config: HierarchyConfig) -> DataFrame:
    """Scores all rows that a (song_id, v) stream holds now and gives the written result. Each micro-batch lands in a
    folder of its own that a repeated attempt overwrites."""
    spark = stream.sparkSession
    out, state = shared.new_path(spark, "stream-ids"), shared.new_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        predict(batch, centers, allowed, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("song_id string, l1 int, l2 int, l3 int, batch int").parquet(out).drop("batch")
