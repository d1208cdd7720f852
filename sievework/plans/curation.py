"""The staged run over an item table: duplicates, clusters, scores, selection, report; each stage is a written table.

``python -m sievework.plans.curation --input items.parquet --output out [--from-stage score] [--dry-run]``
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators import density, features, graphs, ordered, ranking, selection, similarity

STAGES = ("dedup", "cluster", "score", "select", "report")


def dedup(items: DataFrame, cosine: float = 0.92, gap: float = 3.0) -> DataFrame:
    """is_duplicate: equal hashes, near vectors behind a better item, and all but the best of a burst; private items keep theirs."""
    rank = F.struct((-F.col("blur_score")).alias("b"), (-F.col("file_size")).alias("s"), F.col("id").alias("i"))
    open_ = items.filter("is_private = 0")
    near = similarity.cosine_pairs(open_, "id", "clip_emb", cosine).select("a", "b")
    same = Window.partitionBy("file_hash").orderBy("rank")
    exact = open_.filter("file_hash <> ''").select("id", "file_hash", rank.alias("rank")).withColumn("a", F.first("id").over(same)).filter("a <> id").select("a", F.col("id").alias("b"))
    beaten = graphs.greedy_kept(open_.select("id", rank.alias("rank")), near.union(exact)).filter("not kept").select("id")
    burst = ordered.gap_sessions(open_.filter("timestamp > 0"), "timestamp", gap, "id")
    late = burst.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("blur_score"), F.desc("file_size"), "timestamp", "id"))).filter("r > 1").select("id")
    gone = beaten.union(late).distinct().withColumn("_gone", F.lit(1))
    return items.drop("is_duplicate").join(gone, "id", "left").withColumn("is_duplicate", F.coalesce("_gone", F.lit(0))).drop("_gone")


def cluster(items: DataFrame, eps: float = 3.0, min_samples: int = 2, components: int = 32) -> DataFrame:
    """cluster_id: density clusters of the kept items over scaled time, place and the vector's principal components; -1 for those alone."""
    kept = items.filter("is_duplicate = 0")
    x = features.reduced(features.scaled(kept.select("id", "timestamp", "lat", "lon", "clip_emb"), F.col("id")), "clip_emb", components)
    found = density.clusters(x.select("id", F.concat(F.array("f_time", "f_lat", "f_lon"), "f_visual").alias("f")), eps, min_samples).withColumnRenamed("cluster", "_c")
    return items.drop("cluster_id").join(found, "id", "left").withColumn("cluster_id", F.coalesce("_c", F.lit(-1))).drop("_c")


def run(spark: SparkSession, items: DataFrame, out: str, from_stage: str = STAGES[0], rules: selection.Rules = selection.Rules(percentage=0.15), dry_run: bool = False) -> DataFrame:
    """Goes through the stages from the given one on; earlier ones are read from out."""
    begin = STAGES.index(from_stage)
    steps = {
        "dedup": dedup,
        "cluster": cluster,
        "score": lambda x: ranking.score(x.filter("is_duplicate = 0 and is_private = 0")),
        "select": lambda x: x.join(selection.select(x.withColumn("is_frequent", ((F.col("person_id") >= 0) & (F.count("*").over(Window.partitionBy("person_id")) >= 3)).cast("int")), rules), "path"),
        "report": selection.report,
    }
    table = items if not begin else spark.read.parquet(f"{out}/{STAGES[begin - 1]}")
    for name in STAGES[begin:]:
        table = steps[name](table)
        if name == "report" and dry_run:
            return table
        table.write.mode("overwrite").parquet(f"{out}/{name}")
        table = spark.read.parquet(f"{out}/{name}")
    return table


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--from-stage", choices=STAGES, default=STAGES[0])
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args()
    if a.input.rstrip("/") == a.output.rstrip("/") or a.output.startswith(a.input.rstrip("/") + "/"):
        p.error("input and output must be apart")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, spark.read.parquet(a.input), a.output, a.from_stage, dry_run=a.dry_run).orderBy("pick").show(20, truncate=False)


if __name__ == "__main__":
    main()
