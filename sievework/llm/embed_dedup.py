"""Embedding near-duplicates by NN-descent: a neighbour graph is refined by joins of neighbours' neighbours.

Exact copies become one class, a node. Nodes of a label and width start with neighbours from groups that share the signs of
random projections; then every node's neighbours, in both directions, meet in one group, and each takes the best of
what it meets. A list that is full of links is saturated and grows in the next round. Lists are refined until a round finds
few new entries. The search runs on half precision; a pair is linked by its cosine in double precision alone.

What lists cannot hold is found exactly: nodes whose lists are still full of links at their largest size are
compared with their whole label by blocks. Recall is audited on nodes drawn by hash from every label, by brute force over
the label, as a mean over nodes that have links, so that no dense group outweighs the others; a label that stays below
``least_recall`` is compared whole. ``n_links`` is counted exactly, by blocks inside the components that the edges make.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or id,
link with nothing and are kept; rows of other widths don't link; repeated rows are copies of each other and count as
links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import stored, table
from sievework.llm.components import components, forest

#: Cosines of half-precision vectors are trusted up to this.
SLACK = 0.004
EDGE = "node long, other long, s float"


def units(vectors: list[bytes], kind: type = np.float64) -> np.ndarray:
    """Vectors of one width, as stored, over their norms."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64 if kind is np.float64 else np.float32)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Rows ordered by their first columns, put together by these, as columns: numbers as numpy, others as lists."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> list:
        t = pa.Table.from_batches(held).combine_chunks()
        return [c.to_pylist() if pa.types.is_binary(c.type) or pa.types.is_string(c.type) else c.to_numpy() for c in t.columns]

    for b in batches:
        if not b.num_rows:
            continue
        names = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in names:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(cut, cut[1:]):  # noqa: B905
            key = tuple(c[x] for c in names)
            if held and key != last:
                yield whole()
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield whole()


def classes(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the vector is its doubles as bytes, so that equal ones meet by plain hashing; null where it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(2):
                x = np.asarray(v.values.fill_null(np.nan)) + 0.0
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    return rows.mapInArrow(run, "vec_id long, label string, vector binary")


def sketched(nodes: DataFrame, trees: int, bits: int) -> DataFrame:
    """(node, root, half, signs) of (node, root, vector): the unit vector in half precision, and per tree the signs of random projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            half, signs = [], []
            for v in b.column(2):
                x = units([v.as_py()])[0]
                if (p := planes.get(len(x))) is None:
                    p = planes[len(x)] = np.random.default_rng(len(x)).standard_normal((trees * bits, len(x)))
                half.append(x.astype(np.float16).tobytes())
                signs.append((((p @ x > 0).reshape(trees, bits)) @ (1 << np.arange(bits - 1, -1, -1))).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(half, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["node", "root", "half", "signs"])

    return nodes.select("node", "root", "vector").mapInArrow(run, "node long, root string, half binary, signs array<long>")


def _best(at: np.ndarray, ids: np.ndarray, s: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, s) of the best so many others of each row of similarities between the group's members."""
    k = min(int(most.max()), s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
    value = np.take_along_axis(s, top, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    keep = (np.arange(k)[None, :] < most[:, None]) & np.isfinite(value)
    rows = np.nonzero(keep)[0]
    return ids[at[rows]], ids[top[keep]], value[keep]


def _similar(x: np.ndarray, a: int, z: int) -> np.ndarray:
    s = x[a:z] @ x.T
    s[np.arange(z - a), np.arange(a, z)] = -np.inf
    return s


def seeded(nodes: DataFrame, trees: int, k: int, leaf: int) -> DataFrame:
    """EDGE: for each node of (node, root, half, signs) its best k of the groups it falls in, one group per tree.

    A group is told apart by as many signs as its root's size asks for; what is still larger is dealt by a hash.
    """
    sizes = nodes.groupBy("root").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(leaf)))).cast("int").alias("depth"))
    each = nodes.join(sizes, "root").select("root", "node", "half", "depth", F.posexplode("signs").alias("tree", "sign"))
    placed = each.select("root", "tree", "node", "half", F.expr("shiftrightunsigned(sign, 30 - least(depth, 30))").alias("part"))
    full = placed.groupBy("root", "tree", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * leaf)).cast("int").alias("deals"))
    dealt = placed.join(full, ["root", "tree", "part"]).withColumn("deal", F.pmod(F.xxhash64("node", "tree"), F.col("deals")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, ids, half in groups(batches, 4):
            if len(ids) < 2:
                continue
            x = units(half, np.float16)
            for a in range(0, len(ids), 512):
                z = min(len(ids), a + 512)
                found = _best(np.arange(a, z), ids, _similar(x, a, z), np.full(z - a, k))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*found[:2], found[2].astype(np.float32))], ["node", "other", "s"])

    keys = ["root", "tree", "part", "deal"]
    return dealt.select(*keys, "node", "half").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, EDGE)


def merged(edges: DataFrame, k: int, threshold: float, largest: int) -> DataFrame:
    """(node, other, s): each node's best distinct entries of EDGE; k of them, and all links up to ``largest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank, seen = None, 0, set()
        for b in batches:
            node, other, s = (c.to_numpy() for c in b.columns)
            keep = np.zeros(len(node), bool)
            for i, (v, o, x) in enumerate(zip(node.tolist(), other.tolist(), s.tolist(), strict=True)):
                if v != last:
                    last, rank, seen = v, 0, set()
                if o not in seen and (rank < k or x >= threshold - SLACK and rank < largest):
                    seen.add(o)
                    rank += 1
                    keep[i] = True
            yield b.filter(pa.array(keep))

    return edges.repartition("node").sortWithinPartitions("node", F.desc("s"), "other").mapInArrow(run, EDGE)


def refined(nodes: DataFrame, graph: DataFrame, k: int, reverse: int, threshold: float) -> DataFrame:
    """EDGE: what the neighbours of each node, both ways, are to each other, as far as it betters their lists or links them.

    Of those that name a node ``reverse`` take part, the nearest; the others are met through their own lists.
    """
    worst = graph.groupBy("node").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("n"))
    carried = nodes.select("node", "half").join(worst, "node", "left").select("node", "half", F.when(F.col("n") >= k, F.least("worst", F.lit(threshold - SLACK - 1e-4))).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    back = graph.select(F.col("other").alias("at"), F.col("node").alias("member"), "s")
    meet = graph.select(F.col("node").alias("at"), F.col("other").alias("member"), "s").union(back).union(graph.select(F.col("node").alias("at"), F.col("node").alias("member"), F.lit(2.0).cast("float").alias("s")).distinct())

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (at, member, s) in order: of each group the nearest members, each once."""
        last, rank, seen = None, 0, set()
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (a, m) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if a != last:
                    last, rank, seen = a, 0, set()
                if m not in seen and rank < reverse:
                    seen.add(m)
                    rank += 1
                    keep[i] = True
            yield b.filter(pa.array(keep)).select(["at", "member"])

    some = meet.repartition("at").sortWithinPartitions("at", F.desc("s"), "member").mapInArrow(chosen, "at long, member long")
    rows = some.join(carried.withColumnRenamed("node", "member"), "member").select("at", "member", "worst", "half")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for _, ids, worst, half in groups(batches, 1):
            x = units(half, np.float16)
            s = _similar(x, 0, len(ids))
            s[s <= worst[:, None]] = -np.inf
            out.append(_best(np.arange(len(ids)), ids, s, np.full(len(ids), k)))
            if len(out) >= 500:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        a, b, s = (np.concatenate(v) for v in zip(*out, strict=True))
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (a[first], b[first], s[first].astype(np.float32))], ["node", "other", "s"])

    return rows.repartition("at").sortWithinPartitions("at", "member").mapInArrow(run, EDGE)


def descent(nodes: DataFrame, threshold: float, k: int = 12, trees: int = 4, leaf: int = 192, rounds: int = 4, largest: int = 48) -> tuple[DataFrame, int]:
    """((node, other, s): the neighbour lists of (node, root, vector), the links a list has room for at last)."""
    sketch = stored(sketched(nodes, trees, 30), "sketch")
    graph = stored(merged(seeded(sketch, trees, k, leaf), k, threshold, largest), "graph")
    before, room = graph.agg(F.count_if(F.col("s") >= threshold - SLACK)).first()[0], largest
    for i in range(rounds):
        room = min(largest, k << (i + 1))
        found = refined(sketch, graph, k, 2 * k << i, threshold)  # fuller lists take more in
        graph = stored(merged(graph.union(found), k, threshold, room), "graph")
        links = graph.agg(F.count_if(F.col("s") >= threshold - SLACK)).first()[0]
        if links - before <= 0.002 * links:
            break
        before = links
    return graph, room


def verified(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b) whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                one, two = t.column(2).to_pylist(), t.column(3).to_pylist()
                keep = pa.array([float(u @ v) >= threshold for u, v in ((units([x])[0], units([y])[0]) for x, y in zip(one, two, strict=True))], pa.bool_())
                yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])

    v = nodes.select("node", "vector")
    return edges.join(v.toDF("a", "x"), "a").join(v.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def compared(members: DataFrame, threshold: float, block: int = 512, asked: str | None = None) -> DataFrame:
    """(node, n, least) for each node of (root, node, vector, copies) and each pair of blocks of its root that it is in.

    n is how many rows of other nodes there reach the threshold, least the smallest node that such links connect there.
    The members of a root are dealt to blocks; each pair of blocks is one group, so no group exceeds two blocks. With the
    boolean column ``asked`` only blocks that hold such members meet the others.
    """
    wanted = F.col(asked) if asked else F.lit(True)
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.ceil(F.count_if(wanted) / F.lit(block)).cast("int").alias("first"))
    own = F.pmod(F.xxhash64("node"), F.col("first")) if asked else F.pmod(F.xxhash64("node"), F.col("blocks"))
    if asked:  # asked members fill the first blocks, the others those behind
        own = F.when(wanted, own).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.col("blocks") - F.col("first") + 1)))
    dealt = members.join(sizes.filter("first > 0"), "root").withColumn("own", own.cast("int"))
    last = F.col("blocks") if asked else F.col("blocks") - 1
    others = F.when(F.col("own") < F.col("first"), F.sequence(F.lit(0), last)).otherwise(F.sequence(F.lit(0), F.col("first") - 1))
    keyed = dealt.withColumn("other", F.explode(others)).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, ids, copies, vectors in groups(batches, 3):
            x, same = units(vectors), i[0] == j[0]
            n = np.zeros(len(ids), np.int64)

            def links(same=same, x=x, copies=copies, own=own, n=n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for a in range(0, len(x), 512):
                    hit = x[a : a + 512] @ x.T >= threshold
                    if not same:
                        hit &= own[a : a + 512, None] != own[None, :]
                    n[a : a + 512] = hit @ copies
                    one, other = np.nonzero(hit)
                    yield one + a, other

            least = forest(len(ids), links())
            if same:
                n -= copies  # a node meets itself
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(ids[least])], ["node", "n", "least"])  # ids are in order, so the smallest position is the smallest node

    return keyed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(run, "node long, n long, least long")


def counted(members: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(node, n): for each node of (root, node, vector, copies) the rows of other nodes of its root that reach the threshold."""
    return compared(members, threshold, block).groupBy("node").agg(F.sum("n").alias("n"))


def audit(members: DataFrame, roots: DataFrame, threshold: float, audited: int, block: int = 512) -> DataFrame:
    """(root, nodes, recall): of nodes of every root, the mean share of their links, by brute force over the root, that lie in their component.

    ``audited`` nodes are drawn by hash from all and as many from those with a component; nodes without links don't count.
    """
    where = members.join(roots, "node", "left")
    drawn = F.row_number().over(Window.partitionBy("root", "known").orderBy("h", "node"))
    each = where.select("root", "node", F.xxhash64("node", F.lit(1)).alias("h"), F.explode(F.expr("if(component is null, array(false), array(false, true))")).alias("known"))
    asked = each.withColumn("r", drawn).filter(F.col("r") <= audited).select("node").distinct().withColumn("asked", F.lit(True))
    marked = stored(where.join(asked, "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "audited")
    only = marked.filter("asked").select("node", F.col("root").alias("label"))
    told = lambda m: compared(m, threshold, block, "asked").groupBy("node").agg(F.sum("n").alias("n"))
    true = told(marked).join(only, "node").filter("n > 0")
    hit = told(marked.filter("component is not null").withColumn("root", F.col("component").cast("string"))).toDF("node", "hit")
    found = true.join(hit, "node", "left").select(F.col("label").alias("root"), (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("share"))
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.avg("share").alias("recall"))


def linked(members: DataFrame, threshold: float, block: int = 512, largest: int = 48, audited: int = 64, least_recall: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """((node, component) of linked nodes of (root, node, vector, copies), the audit by root)."""
    graph, room = descent(members, threshold, largest=largest)
    near = graph.filter(F.col("s") >= threshold - SLACK)
    pairs = near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    edges = stored(verified(pairs, members, threshold), "links")
    # Lists that links fill to the last place may lack some: these nodes are compared with all of their root.
    saturated = near.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= room).select("node", F.lit(True).alias("full"))
    forest_of = lambda met: met.filter("least <> node").select(F.col("node").alias("a"), F.col("least").alias("b"))
    marked = stored(members.join(saturated, "node", "left").withColumn("full", F.coalesce("full", F.lit(False))), "marked")
    edges = stored(edges.union(forest_of(compared(marked, threshold, block, "full"))), "links")
    roots = stored(components(edges).toDF("node", "component"), "components")
    told = stored(audit(members, roots, threshold, audited), "audit")
    weak = told.filter(F.col("recall") < least_recall).select("root")
    if not weak.isEmpty():
        whole = members.join(weak, "root", "left_semi")
        edges = edges.union(forest_of(compared(whole, threshold, block)))
        roots = stored(components(edges).toDF("node", "component"), "components")
    return roots, told


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = 512, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    rows = stored(classes(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("v"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    taking_part = rows.filter("vec_id is not null and label is not null and vector is not null")
    nodes = stored(taking_part.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select(F.concat_ws(":", F.length("vector"), "label").alias("root"), "node", "vector", "copies")
    roots, _ = linked(members, threshold, block, **how)
    inside = members.join(roots, "node").select(F.col("component").cast("string").alias("root"), "node", "vector", "copies")
    n = counted(inside, threshold, block)
    of_node = stored(nodes.join(roots, "node", "left").join(n, "node", "left").select("label", "vector", "first", "copies", F.coalesce("component", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n")), "linked")
    least = of_node.groupBy("root").agg(F.min("first").alias("component_id"))
    told = of_node.join(least, "root").select("label", "vector", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    # Copies of one vector may be many: their rows are dealt over salts, the one row that tells of them is repeated.
    salts = 16
    salted = rows.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
    found = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = salted.join(found, ["label", "vector", "salt"], "left")
    out = out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
