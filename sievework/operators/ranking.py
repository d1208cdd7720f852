"""The composite ranker: nine components, min-max scaled over the whole table, in one aggregate and one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import minmax

# The components' default weights.
WEIGHTS = {"sharpness": 0.10, "aesthetic": 0.20, "face_score": 0.18, "face_prominence": 0.10, "face_confidence": 0.05, "sentiment": 0.18, "uniqueness": 0.10, "metadata_importance": 0.05, "diversity_bonus": 0.04}
DEFAULTS = {"face_prominence": 0.0, "face_confidence": 0.0}


def components(items: DataFrame) -> DataFrame:
    """Raw components; sizes of clusters come back by a join on the cluster, noise is its own cluster of one."""
    sizes = items.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("_n"))
    top = sizes.agg(F.coalesce(F.max("_n"), F.lit(1)).alias("_top"))
    x = items.join(sizes, "cluster_id", "left").crossJoin(F.broadcast(top))  # one row
    raw = {
        "sharpness": F.col("blur_score"),
        "aesthetic": F.col("aesthetic_score"),
        "face_score": F.log1p(F.least(F.greatest(F.col("face_count"), F.lit(0)), F.lit(10)).cast("double")),
        "sentiment": F.col("smile_score"),
        "metadata_importance": F.when(F.col("has_gps") > 0, 1.0).otherwise(0.4) * F.when(F.col("timestamp") > 0, 1.0).otherwise(0.6),
        "uniqueness": F.coalesce(1 / F.col("_n"), F.lit(1.0)),
        **{k: F.col(k) if k in items.columns else F.lit(v) for k, v in DEFAULTS.items()},
        "diversity_bonus": F.coalesce(F.col("_n") / F.col("_top"), F.lit(0.0)),
    }
    return x.select(*items.columns, *(v.cast("double").alias(f"_{k}") for k, v in raw.items()))


def score(items: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """items with score."""
    raw = components(items)
    ends = raw.agg(*(f(f"_{k}").alias(f"{n}_{k}") for k in weights for n, f in (("lo", F.min), ("hi", F.max))))
    x = raw.crossJoin(F.broadcast(ends))  # one row
    total = sum((F.lit(w) * minmax(F.col(f"_{k}"), F.col(f"lo_{k}"), F.col(f"hi_{k}")) for k, w in weights.items()), F.lit(0.0))
    return x.select(*items.columns, total.alias("score"))
