"""Iterative graph operators: greedy independent sets in rank order, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.store import stored


def greedy_kept(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept) for items (id, rank): an item goes when a kept one of smaller rank is its neighbour.

    In each round items without an open earlier neighbour stay, and neighbours of those that stay go.
    """
    ranked = items.select("id", "rank")
    e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = e.join(ranked.toDF("a", "ra"), "a").join(ranked.toDF("b", "rb"), "b").filter("ra < rb").select("a", "b").distinct()  # a comes before b
    state = stored(ranked.select("id").withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    e = stored(e, "greedy_edges")
    while not state.filter("kept is null").isEmpty():
        of = e.join(state.toDF("a", "ka"), "a").filter("ka is null or ka").groupBy("b").agg(F.max(F.coalesce("ka", F.lit(False))).alias("beaten")).withColumnRenamed("b", "id")
        nxt = state.join(of, "id", "left").select("id", F.coalesce("kept", F.when(F.col("beaten").isNull(), True).when(F.col("beaten"), False)).alias("kept"))
        state = stored(nxt, "greedy")
    return state


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component.

    In each round every node moves to the one of its closed neighbourhood that comes first by a hash, which changes from
    round to round; so a chain in any numbering loses a fixed share of its nodes a round, and the rounds grow with the
    logarithm of the longest path. The moves are followed once at the end.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "cc")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        key = lambda c, salt=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("id"))
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        to = stored(first.select("a", F.least("m", key("a"))["id"].alias("to")), "cc")
        moves.append(to)
        moved = edges.join(to, "a").select(F.col("to").alias("x"), "b").join(to.toDF("b", "y"), "b")
        edges = stored(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc")
    out = nodes.select("id", F.col("id").alias("at"))
    for to in moves:
        out = out.join(to.toDF("at", "to"), "at", "left").select("id", F.coalesce("to", "at").alias("at"))
    if not moves:
        return out.select("id", F.col("at").alias("root"))
    out = stored(out, "cc")
    return out.join(out.groupBy("at").agg(F.min("id").alias("root")), "at").select("id", "root")


def dbscan_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): clusters of at least two by reach, named by their smallest id; -1 for the others (min_samples 2)."""
    roots = connected(nodes, edges)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    return roots.join(sizes, "root").select("id", F.when(F.col("n") > 1, F.col("root")).otherwise(F.lit(-1)).alias("cluster"))


def dbscan(nodes: DataFrame, edges: DataFrame, min_samples: int = 2) -> DataFrame:
    """(id, cluster): cores have min_samples items within reach, themselves counted; a border item joins the first cluster it reaches."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = stored(nodes.join(both.groupBy("a").agg(F.count("*").alias("d")).withColumnRenamed("a", "id"), "id", "left").filter(F.coalesce("d", F.lit(0)) + 1 >= min_samples).select("id"), "core")
    inner = edges.join(core.toDF("a"), "a").join(core.toDF("b"), "b").select("a", "b")
    roots = stored(connected(core, inner), "roots")
    border = both.join(roots.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "id")
    return nodes.select("id").join(roots, "id", "left").join(border, "id", "left").select("id", F.coalesce("root", "near", F.lit(-1)).alias("cluster"))
