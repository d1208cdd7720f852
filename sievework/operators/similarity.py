"""All pairs of vectors or sketches that are near enough, by blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row)
    if held:
        yield key, held


def block_pairs(items: DataFrame, id_column: str, value: str, near: Callable[[list, list], tuple[np.ndarray, np.ndarray, np.ndarray]], block: int = 2048) -> DataFrame:
    """(a, b, s), a < b, for the pairs that ``near(left values, right values)`` returns as (i, j, s).

    Rows are dealt to blocks by a hash of their id; each pair of blocks is one group of at most two blocks' rows.
    """
    rows = items.select(F.col(id_column).cast("long").alias("id"), F.col(value).alias("v")).filter("v is not null")
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v").repartition("i", "j").sortWithinPartitions("i", "j", "own", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), held in _sides(batches, 2):
            left = [r for r in held if r[2] == i]
            right = left if i == j else [r for r in held if r[2] == j]
            if left and right:
                x, y, s = near([r[4] for r in left], [r[4] for r in right])
                a, b = np.array([r[3] for r in left])[x], np.array([r[3] for r in right])[y]
                keep = a < b if i == j else a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(s[keep].astype(np.float64))], ["a", "b", "s"])

    return keyed.mapInArrow(run, "a long, b long, s double")


def cosine_pairs(items: DataFrame, id_column: str, vector: str, threshold: float, block: int = 2048) -> DataFrame:
    def near(a: list, b: list):
        unit = lambda x: (m := np.array(x, np.float64)) / np.linalg.norm(m, axis=1, keepdims=True).clip(1e-8)
        s = unit(a) @ unit(b).T
        x, y = np.nonzero(s >= threshold)
        return x, y, s[x, y]

    return block_pairs(items, id_column, vector, near, block)


def hamming_pairs(items: DataFrame, id_column: str, bits: str, most: int, block: int = 4096) -> DataFrame:
    def near(a: list, b: list):
        d = np.bitwise_count(np.array(a, np.int64).view(np.uint64)[:, None] ^ np.array(b, np.int64).view(np.uint64)[None, :])
        x, y = np.nonzero(d <= most)
        return x, y, d[x, y]

    return block_pairs(items, id_column, bits, near, block)


def nearest(queries: DataFrame, items: DataFrame, id_column: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query, id, s): each query's k nearest other items by cosine; ties go to the smaller id."""
    from pyspark.sql import Window

    rows = items.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).filter("v is not null")
    asked = queries.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).filter("v is not null")
    n, m = (max(1, -(-x.count() // block)) for x in (rows, asked))
    right = rows.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = asked.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        unit = lambda t: (x := np.array(t.column("v").to_pylist(), np.float64).reshape(t.num_rows, -1)) / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-8)
        a, b, out = q.column("id").to_numpy(), c.column("id").to_numpy(), ([], [], [])
        if len(a) and len(b):
            s = unit(q) @ unit(c).T
            for row in range(len(a)):
                best = [x for x in np.lexsort((b, -s[row]))[: k + 1] if b[x] != a[row]][:k]
                for o, x in zip(out, (np.full(len(best), a[row]), b[best], s[row][best]), strict=True):
                    o.append(x)
        cat = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        return pa.table({"query": pa.array(cat(out[0], np.int64)), "id": pa.array(cat(out[1], np.int64)), "s": pa.array(cat(out[2], np.float64))})

    each = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "query long, id long, s double")
    order = Window.partitionBy("query").orderBy(F.desc("s"), "id")
    return each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("query", "id", "s")
