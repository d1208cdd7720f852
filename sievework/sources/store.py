"""Tables as the store: scans, incremental reads, partial upserts, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.functions.scalars import hash_matches
from sievework.functions.vectors import usable


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a session in one process may lack it and gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    df.write.parquet(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


def scan_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".heic")) -> DataFrame:
    """path, file_size, file_hash, file_md5, content of the files below a folder with one of the suffixes; sort by path where order matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | F.lower("path").endswith(s)
    return files.filter(fits).select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), F.md5("content").alias("file_md5"), "content")


def conform(df: DataFrame, schema: StructType, defaults: dict) -> DataFrame:
    """df with all columns of the schema: missing ones take their default, others their type."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def new_rows(scanned: DataFrame, cached: DataFrame) -> DataFrame:
    """Scanned (path, file_hash, file_md5) rows whose cached hash is absent or another one."""
    same = cached.select("path", F.col("file_hash").alias("_cached"))
    return scanned.join(same, "path", "left").filter(~F.coalesce(hash_matches(F.col("_cached"), F.col("file_hash"), F.col("file_md5")), F.lit(False))).drop("_cached")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """old with the rows of new put in; only the columns that new has are taken from it."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    columns = [key, *[c for c in old.columns if c != key]]
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c == key else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*(pick(c).alias(c) for c in columns))


def missing_vectors(items: DataFrame, vectors: DataFrame, dim: int, key: str = "path", vector: str = "clip_emb") -> DataFrame:
    """Items with a usable vector of the right width that the collection lacks."""
    return items.filter(usable(F.col(vector)) & (F.size(vector) == dim)).join(vectors.select(key), key, "left_anti").select(key, vector)
