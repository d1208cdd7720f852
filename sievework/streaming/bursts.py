"""Streaming forms of the batch operators: bursts by session windows, counts per hour, and incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, ts: str = "ts", gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """start, end, n of each burst; a gap of exactly ``gap`` stays within it. Rows later than ``late`` are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_hour(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("hour"), key, "n")


def new_by_hash(scanned: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each file_hash within the watermark."""
    return scanned.withWatermark(ts, late).dropDuplicatesWithinWatermark(["file_hash"])


def each_batch(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Runs merge, such as an upsert into a table, on each micro-batch; restarts go on at the checkpoint."""
    return stream.writeStream.foreachBatch(lambda df, _: merge(df)).option("checkpointLocation", checkpoint)
