"""Connected components by contraction, as joins and partial aggregates; nothing is collected.

In every round each node points to the smallest of itself and its neighbours, in the order of its number or, every
second round, of a hash; both ends of each edge are replaced by what they point to, until no edge is left. A star
needs one round, a path of n nodes O(log n) expected rounds. Hot nodes are summed before the shuffle, and the joins
are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); nodes of one component share the root."""
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        order = (lambda x: F.xxhash64(x, F.lit(len(maps)))) if len(maps) % 2 else (lambda x: x)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("x"))).alias("m"))
        own = F.struct(order(F.col("a")).alias("o"), F.col("a").alias("x"))
        to = stored(least.select(F.col("a").alias("node"), F.least("m", own)["x"].alias("to")), "roots")
        moved = edges.join(to.toDF("a", "x"), "a").select("b", "x").join(to.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = stored(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        maps.append(to)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].toDF("node", "root")
    for m in maps[1:]:
        out = out.join(m.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the smallest position that the pairs connect it with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, jumped := root[root]):
                root = jumped
    return root
