"""Feature columns of items for density clustering: scaled time and place, and reduced vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(items: DataFrame, index: Column, time_weight: float = 1.0, gps_weight: float = 2.0) -> DataFrame:
    """items with f_time, f_lat and f_lon: hours since the first, hundredths of degrees, weighted.

    Items without place get the centre of the others; those without time lie far off and apart from each other.
    """
    placed = (F.col("lat") != 0) | (F.col("lon") != 0)
    ends = items.agg(F.min(F.when(F.col("timestamp") > 0, F.col("timestamp"))).alias("_t0"), F.coalesce(F.avg(F.when(placed, F.col("lat"))), F.lit(0.0)).alias("_la"), F.coalesce(F.avg(F.when(placed, F.col("lon"))), F.lit(0.0)).alias("_lo"))
    time = F.when(F.col("timestamp") > 0, (F.col("timestamp") - F.col("_t0")) / 3600 * time_weight).otherwise(1e6 + 100.0 * index)
    place = lambda c, mean: F.when(placed, F.col(c)).otherwise(F.col(mean)) * 100 * gps_weight
    return items.crossJoin(F.broadcast(ends)).withColumns({"f_time": time, "f_lat": place("lat", "_la"), "f_lon": place("lon", "_lo")}).drop("_t0", "_la", "_lo")  # one row


def reduced(items: DataFrame, vector: str, k: int = 32, weight: float = 1.5, out: str = "f_visual") -> DataFrame:
    """items with ``out``: the vector's first k principal components, of length one, weighted; zeros where k rows are lacking."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    zeros = F.array_repeat(F.lit(0.0), k)
    rows = items.filter(F.col(vector).isNotNull())
    width = rows.select(F.max(F.size(vector))).first()[0]
    if not width or rows.limit(k + 1).count() <= k:
        return items.withColumn(out, zeros)
    filled = items.withColumn("_v", array_to_vector(F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), width))))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(filled).transform(filled)
    x = PCA(k=min(k, width), inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("_p", vector_to_array("_p"))
    length = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda s, y: s + y * y))
    return x.withColumn(out, F.transform("_p", lambda y: F.when(length < 1e-8, 0.0).otherwise(y / length) * weight)).drop("_v", "_c", "_p")
