"""What the operators of this package share: the shared folder, tables written to cut lineage, and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in one process (``local[...]``) may lack it, as in tests; it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it survives the loss of executors and cuts lineage."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, when nothing lazy reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Gives what a task has freed back to the system; a Python worker lives on beside the next stage's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(df: DataFrame, base: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def remainder(column: str, modulus: int):
    """crc32 of the column as text, modulo modulus; of null as of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def each_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """f over every batch, for mapInArrow; empty batches are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


#: ASCII capitals to small letters, in bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the text in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()
