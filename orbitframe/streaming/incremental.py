"""Batches of a stream run through the batch operators: every arrival recomputes what it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and means per window and key; rows later than ``late`` are left out."""
    from pyspark.sql import functions as F

    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def on_each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on every micro-batch available now."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
