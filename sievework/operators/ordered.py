"""Running values over a whole ordered table in two steps, so that no task sorts all rows.

A coarse, monotone bucket of the order key is the window's partition; one row per bucket carries what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """name: the sum of value from the first row of the order to this one."""
    df = df.withColumns({"_b": bucket, "_v": value})
    before = df.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = before.select("_b", (F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_p"))
    inside = F.sum("_v").over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(before, "_b").withColumn(name, F.col("_p") + inside).drop("_b", "_v", "_p")


def gap_sessions(df: DataFrame, ts: str, gap: float, tie: str, bucket_seconds: float = 86_400.0, name: str = "session") -> DataFrame:
    """Numbers sessions from 1 in time order; a new one begins after a gap longer than ``gap``."""
    bucket = F.floor(F.col(ts) / bucket_seconds)
    marked = df.withColumn("_b", bucket)
    ends = marked.groupBy("_b").agg(F.max(ts).alias("_e"))
    ends = ends.select("_b", F.lag("_e").over(Window.orderBy("_b")).alias("_e"))
    inside = F.lag(ts).over(Window.partitionBy("_b").orderBy(ts, tie))
    marked = marked.join(ends, "_b").withColumn("_last", F.coalesce(inside, "_e")).drop("_b", "_e")
    new = F.when(F.col("_last").isNull() | (F.col(ts) - F.col("_last") > gap), 1).otherwise(0)
    return running(marked, bucket, [F.col(ts), F.col(tie)], new, name).drop("_last")
