"""The item table ("photos") over the driver's tables, for Spark and as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("clip_emb"))
    labels = table(spark, sf_dir, "labels")
    x = d.join(e, d.doc_id == e.event_id).join(v, d.doc_id == v.vec_id, "left").join(labels, "doc_id", "left")
    x = x.withColumn("t", F.col("ts").cast("timestamp")).withColumn("ep", F.unix_micros("t") / F.lit(1e6))
    stamp = lambda f: F.date_format("t", f)
    name = (
        F.when(F.expr("doc_id % 8 = 0"), F.concat(F.lit("IMG_"), stamp("yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(F.expr("doc_id % 8 = 1"), F.concat(F.lit("IMG-"), stamp("yyyyMMdd"), F.lit("-WA"), F.lpad(F.expr("string(doc_id % 60)"), 4, "0"), F.lit(".jpg")))
        .when(F.expr("doc_id % 8 = 2"), F.concat(F.lit("Screenshot_"), stamp("yyyyMMdd-HHmmss"), F.lit(".png")))
        .when(F.expr("doc_id % 8 = 3"), F.concat(F.expr("string(bigint(floor(ep)))"), F.lit(".jpg")))
        .when(F.expr("doc_id % 8 = 4"), F.concat(stamp("yyyy-MM-dd HH.mm.ss"), F.lit(".jpg")))
        .when(F.expr("doc_id % 8 = 5"), F.concat(F.lit("DSC"), F.lpad(F.expr("string(doc_id % 100000)"), 5, "0"), F.lit(".JPG")))
        .when(F.expr("doc_id % 8 = 6"), F.concat(stamp("yyyyMMddHHmmss"), F.lit(".jpg")))
        .otherwise(F.concat(F.lit("vacation_"), F.col("doc_id").cast("string"), F.lit(".jpg")))
    )
    return x.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/lib/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"),
        F.sha2("text", 256).alias("file_hash"),
        (F.col("n_chars") * 1000).alias("file_size"),
        F.expr("case when doc_id % 11 = 0 then 0D else ep end").alias("timestamp"),
        F.expr("case when doc_id % 3 = 0 then 0D else double((user_id * 37) % 120 - 60) + (doc_id % 10) / 1000D end").alias("lat"),
        F.expr("case when doc_id % 3 = 0 then 0D else double((user_id * 53) % 300 - 150) + (doc_id % 7) / 1000D end").alias("lon"),
        F.expr("case when doc_id % 3 = 0 then 0 else 1 end").alias("has_gps"),
        F.expr("case when doc_id % 4 = 0 then '' else source end").alias("camera_model"),
        F.expr("value * 4D").alias("blur_score"),
        F.expr("(n_chars % 101) / 100D").alias("exposure_score"),
        F.expr("int(480 + (n_chars % 7) * 160)").alias("resolution"),
        F.expr("case when doc_id % 13 = 0 then -1D else double(n_chars % 50) end").alias("detail_stddev"),
        F.expr("case when doc_id % 13 = 0 then -1D else (doc_id % 10) / 10D end").alias("flesh_fraction"),
        F.expr("int(user_id % 4)").alias("face_count"),
        F.expr("int(case when user_id % 4 = 0 then -1 else user_id % 12 end)").alias("person_id"),
        F.expr("(doc_id * 13) % 100 / 100D").alias("aesthetic_score"),
        F.expr("(doc_id * 7) % 100 / 100D").alias("smile_score"),
        F.expr("int(case when doc_id % 9 = 0 then -1 else floor(ep / 21600D) % 1000 end)").alias("cluster_id"),
        F.coalesce("toxic", F.lit(0)).alias("is_private"),
        F.coalesce("quality", F.lit(1)).alias("quality_pass"),
        "clip_emb",
    )


#: The same table in DuckDB.
PHOTOS = """photos AS (
  SELECT doc_id AS id,
    '/lib/' || source || '/' || doc_id || '/' || CASE doc_id % 8
      WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg'
      WHEN 1 THEN 'IMG-' || strftime(ts, '%Y%m%d') || '-WA' || lpad(CAST(doc_id % 60 AS VARCHAR), 4, '0') || '.jpg'
      WHEN 2 THEN 'Screenshot_' || strftime(ts, '%Y%m%d-%H%M%S') || '.png'
      WHEN 3 THEN CAST(CAST(floor(ep) AS BIGINT) AS VARCHAR) || '.jpg'
      WHEN 4 THEN strftime(ts, '%Y-%m-%d %H.%M.%S') || '.jpg'
      WHEN 5 THEN 'DSC' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || '.JPG'
      WHEN 6 THEN strftime(ts, '%Y%m%d%H%M%S') || '.jpg'
      ELSE 'vacation_' || doc_id || '.jpg' END AS path,
    sha256(text) AS file_hash, n_chars * 1000 AS file_size,
    CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE ep END AS timestamp,
    CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE ((user_id * 37) % 120 - 60)::DOUBLE + (doc_id % 10) / 1000.0::DOUBLE END AS lat,
    CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE ((user_id * 53) % 300 - 150)::DOUBLE + (doc_id % 7) / 1000.0::DOUBLE END AS lon,
    CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS has_gps,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS camera_model,
    value * 4.0::DOUBLE AS blur_score, (n_chars % 101) / 100.0::DOUBLE AS exposure_score,
    CAST(480 + (n_chars % 7) * 160 AS INTEGER) AS resolution,
    CASE WHEN doc_id % 13 = 0 THEN -1.0::DOUBLE ELSE (n_chars % 50)::DOUBLE END AS detail_stddev,
    CASE WHEN doc_id % 13 = 0 THEN -1.0::DOUBLE ELSE (doc_id % 10) / 10.0::DOUBLE END AS flesh_fraction,
    CAST(user_id % 4 AS INTEGER) AS face_count,
    CAST(CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id % 12 END AS INTEGER) AS person_id,
    (doc_id * 13) % 100 / 100.0::DOUBLE AS aesthetic_score, (doc_id * 7) % 100 / 100.0::DOUBLE AS smile_score,
    CAST(CASE WHEN doc_id % 9 = 0 THEN -1 ELSE CAST(floor(ep / 21600.0::DOUBLE) AS BIGINT) % 1000 END AS INTEGER) AS cluster_id,
    coalesce(toxic, 0) AS is_private, coalesce(quality, 1) AS quality_pass, embedding AS clip_emb
  FROM (SELECT d.*, e.ts, e.user_id, e.value, epoch(e.ts)::DOUBLE AS ep, v.embedding, l.toxic, l.quality
        FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id))"""
