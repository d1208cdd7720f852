"""Density clustering in several dimensions: an eps join over grid cells that returns forests instead of pairs.

Items are dealt to cells of side eps over the first dimensions; two items within eps share a cell or lie in neighbouring
ones. Each cell meets half of its neighbours, so every pair is met once. A cell of many items is dealt to blocks whose
pairs are tasks of their own, and each task returns a forest of its links, never its pairs. With ``min_samples`` over 2
cores are found first, by counting neighbours in the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import graphs
from sievework.sources.store import stored

MET = "key string, i int, j int, side int, id long, f array<double>"


def _forward(dimensions: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps to a neighbouring cell."""
    return [s for s in product((-1, 0, 1), repeat=dimensions) if s > (0,) * dimensions]


def met(items: DataFrame, eps: float, dimensions: int = 3, block: int = 1024) -> DataFrame:
    """Rows of MET: what has to be compared; side 0 belongs to the cell's own block i, side 1 to the other block j or a neighbour."""
    at = [F.floor(F.col("f")[d] / eps) for d in range(dimensions)]
    cells = items.select("id", "f", F.array(*at).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = stored(cells.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "cells")
    name = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    two = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    # Inside a cell: each block with itself and with the others.
    inner = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: two(F.least("own", k), F.greatest("own", k), (F.col("own") > k).cast("int")))
    inside = rows.select(F.concat(F.lit("own "), name(F.col("cell"))).alias("key"), F.explode(inner).alias("b"), "id", "f").select("key", "b.i", "b.j", "b.side", "id", "f")
    # Across: a cell's blocks with the blocks of each neighbour ahead that holds items.
    shift = lambda s: F.array(*(F.col("cell")[d] + F.lit(v) for d, v in enumerate(s)))
    filled = sizes.select("cell", "blocks")
    ahead = sizes.select("cell", F.col("blocks").alias("here"), F.explode(F.array(*(shift(s) for s in _forward(dimensions)))).alias("next"))
    both = stored(ahead.join(filled.toDF("next", "there"), "next").select("cell", "next", "here", "there", F.concat(F.lit("to "), name(F.col("cell")), F.lit(" "), name(F.col("next"))).alias("key")), "neighbours")
    left = rows.join(both.select("cell", "there", "key"), "cell").select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("there") - 1), lambda k: two(F.col("own"), k, F.lit(0)))).alias("b"), "id", "f")
    right = rows.join(both.select(F.col("next").alias("cell"), "here", "key"), "cell").select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("here") - 1), lambda k: two(k, F.col("own"), F.lit(1)))).alias("b"), "id", "f")
    return inside.union(left.union(right).select("key", "b.i", "b.j", "b.side", "id", "f"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, i, j) with sides, ids and features of rows that are ordered by it."""
    held, key = [], None

    def whole(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts)
        f = t.column("f").combine_chunks()
        return t.column("side").to_numpy(), t.column("id").to_numpy(), np.asarray(f.flatten()).reshape(t.num_rows, -1)

    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        cut = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
        for x, y in zip(cut, cut[1:]):  # noqa: B905
            if x < y:
                if held and keys[x] != key:
                    yield key, *whole(held)
                    held = []
                key = keys[x]
                held.append(b.slice(x, y - x))
    if held:
        yield key, *whole(held)


def _near(key: tuple, side: np.ndarray, f: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within eps; inside one block each pair once, else those of different sides."""
    left = np.flatnonzero(side == 0)
    alone = key[0].startswith("own ") and key[1] == key[2]
    right = left if alone else np.flatnonzero(side == 1)
    for a in range(0, len(left), 256):
        some = left[a : a + 256]
        d = np.zeros((len(some), len(right)))
        for k in range(f.shape[1]):
            d += np.square(f[some, k][:, None] - f[right, k][None, :])
        x, y = np.nonzero(d <= eps * eps)
        x, y = some[x], right[y]
        keep = x < y if alone else np.ones(len(x), bool)
        yield x[keep], y[keep]


def links(items: DataFrame, eps: float, dimensions: int = 3, block: int = 1024) -> DataFrame:
    """Edges (a, b) of (id, f): a forest whose components are those of all pairs within eps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, ids, f in _groups(batches):
            root = np.arange(len(ids))
            for a, b in _near(key, side, f, eps):
                while len(a):
                    x, y = root[a], root[b]
                    open_ = x != y
                    a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                    np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                    while not np.array_equal(root, jumped := root[root]):
                        root = jumped
            at = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], ["a", "b"])

    keyed = met(items, eps, dimensions, block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
    return keyed.mapInArrow(run, "a long, b long")


def degrees(items: DataFrame, eps: float, dimensions: int = 3, block: int = 1024) -> DataFrame:
    """(id, n): how many other items lie within eps; items without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, ids, f in _groups(batches):
            n = np.zeros(len(ids), np.int64)
            for a, b in _near(key, side, f, eps):
                n += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at])], ["id", "n"])

    keyed = met(items, eps, dimensions, block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
    return keyed.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def clusters(items: DataFrame, eps: float, min_samples: int = 2, dimensions: int = 3, block: int = 1024) -> DataFrame:
    """(id, cluster) of (id long, f array<double>): clusters named by their smallest core, -1 for items that none reaches.

    A border item joins the reachable cluster of the smallest name.
    """
    items = stored(items.select(F.col("id").cast("long").alias("id"), F.col("f").cast("array<double>").alias("f")), "points")
    if min_samples <= 2:
        return graphs.dbscan_pairs(items, links(items, eps, dimensions, block))
    core = stored(degrees(items, eps, dimensions, block).filter(F.col("n") + 1 >= min_samples).select("id"), "core")
    roots = stored(graphs.connected(core, links(items.join(core, "id", "left_semi"), eps, dimensions, block)), "roots")
    # A border item is linked with the cores of its cell and the cells around; the cluster of the smallest name counts.
    border = items.join(core, "id", "left_anti")
    near = _border(border, items.join(roots, "id"), eps, dimensions)
    found = roots.select("id", "root").union(near)
    return items.select("id").join(found, "id", "left").select("id", F.coalesce("root", F.lit(-1)).alias("cluster"))


def _border(border: DataFrame, cores: DataFrame, eps: float, dimensions: int) -> DataFrame:
    at = lambda df: F.array(*(F.floor(df["f"][d] / eps) for d in range(dimensions)))
    steps = F.array(*(F.array(*(F.lit(v) for v in s)) for s in product((-1, 0, 1), repeat=dimensions)))
    asked = border.withColumn("cell", F.explode(F.transform(steps, lambda s: F.zip_with(at(border), s, lambda x, y: x + y))))
    pairs = asked.join(cores.select(at(cores).alias("cell"), F.col("f").alias("g"), "root"), "cell")
    return pairs.filter(distance(F.col("f"), F.col("g")) <= eps * eps).groupBy("id").agg(F.min("root").alias("root"))


def distance(a: Column, b: Column) -> Column:
    """The squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
