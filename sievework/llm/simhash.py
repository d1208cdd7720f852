"""SimHash near-duplicates: fingerprints in Gray order under a hierarchical index that prunes whole groups.

Distinct fingerprints are sorted by Gray rank, in which those that share their first bits are neighbours. The upper nodes of
the index are such runs: pairs of nodes go down together as joins, what they differ in is added up on the way, and a pair beyond
the limit is pruned with all that is below. Pairs of runs of bounded size are left; each is one group of rows. There
the index goes on: the fingerprints are grouped in Gray order, a node keeps the bits that all below it share and that no
node above it has, and a search adds up the differences and leaves a group once they exceed the limit. A group returns a
forest of its links, not its pairs. A run grows no longer than the limit however the fingerprints are spread, as it is
told apart by further bits; so no group is hot.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; exact copies,
repeated rows and ties share a fingerprint; a null doc_id is larger than any other when the smallest is sought; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import stored, table, words
from sievework.llm.components import components, forest

BITS = 64
FANOUT = 16
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int, seed: int = 42) -> list[int]:
    """XXH64 of every shingle of the text's words; of the whole sequence where there are fewer words."""
    w = words(text)
    if not w:
        return []
    joined, ends, at = b" ".join(w), [], -1
    for n in map(len, w):
        at += n + 1
        ends.append(at)
    h, starts = xxhash.xxh64_intdigest, [0, *(e + 1 for e in ends)]
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])] if len(w) >= width else [h(joined, seed)]  # noqa: B905


def majorities(hashes: list) -> np.ndarray:
    """For each list the 64-bit word whose bits are set in over half of the list; zero for an empty list."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    return majority_words(np.concatenate([np.asarray(x, np.uint64) for x in hashes if len(x)] or [np.zeros(0, np.uint64)]), sizes)


def majority_words(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same of lists that lie one after the other, of the given sizes."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # Lanes of a byte hold counts to 255, so longer lists are added up in parts.
    parts = [np.arange(0, n, 255) for n in sizes[full]]
    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    at = np.concatenate([p + b for p, b in zip(parts, begin, strict=True)])
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    for k in range(8):
        sums = np.add.reduceat((flat >> np.uint64(k)) & LANES, at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= over[:, byte] << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, fp long), the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                fp = majorities([shingle_hashes(t.as_py() or "", width) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of (shared bits not shared above, their values) over words in Gray order; the last level is the words."""

    def __init__(self, fp: np.ndarray):
        self.order = np.argsort(gray_rank(fp), kind="stable")
        self.fp = fp[self.order]
        ones, zeros = self.fp, ~self.fp  # bits set in all, bits clear in all
        both = [(ones, zeros)]
        while len(ones) > FANOUT:
            at = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            both.append((ones, zeros))
        self.levels = []  # from the top: mask, values
        above = np.zeros(len(both[-1][0]), np.uint64)
        for k, (ones, zeros) in enumerate(reversed(both)):
            shared = ones | zeros
            if k:
                above = np.repeat(above, FANOUT)[: len(shared)]
            self.levels.append((shared & ~above, ones))
            above = shared

    def near(self, most: int, queries: np.ndarray | None = None, step: int = 256, told: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, position in Gray order) of pairs with at most so many differing bits.

        Without queries the words themselves are, and only later positions count. ``told`` gathers the groups met and pruned.
        """
        own = queries is None
        fp = self.fp if own else queries
        n = len(fp)
        for a in range(0, n, step):
            q = np.arange(a, min(n, a + step))
            top = len(self.levels[0][0])
            query, node, seen = np.repeat(q, top), np.tile(np.arange(top), len(q)), np.zeros(len(q) * top, np.uint8)
            span = FANOUT ** (len(self.levels) - 1)
            for k, (mask, value) in enumerate(self.levels):
                if k:
                    query, seen = np.repeat(query, FANOUT), np.repeat(seen, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    span //= FANOUT
                    inside = node < len(mask)
                    query, node, seen = query[inside], node[inside], seen[inside]
                seen = seen + np.bitwise_count((fp[query] ^ value[node]) & mask[node])
                keep = seen <= most
                if told is not None and span > 1:
                    told["met"] = told.get("met", 0) + len(keep)
                    told["pruned"] = told.get("pruned", 0) + int(len(keep) - np.count_nonzero(keep))
                if own:
                    keep &= (node + 1) * span - 1 > query  # a group that lies wholly before the query has met it
                query, node, seen = query[keep], node[keep], seen[keep]
            yield query, node


#: Bits of the fingerprint that one level of the upper index tells apart, and fingerprints that the first nodes of turned orders hold, about.
STEP, FIRST = 6, 256


def _run(level: int, first: int = 0) -> Column:
    """The first bits of fp, which the fingerprints of a node share; in Gray order these are runs of neighbours."""
    bits = min(BITS, first + STEP * level)
    return F.shiftrightunsigned("fp", BITS - bits) if bits else F.lit(0).cast("long")


def surviving(words: DataFrame, most: int, group_limit: int, first: int = 0) -> list[tuple[int, DataFrame]]:
    """(level, pairs (turn, a, b) of its nodes that may hold links, a <= b): every pair of fingerprints of a turn within reach that agree in the first bits is in one of them.

    Nodes of the upper index are runs of the Gray order that share their first bits, ``STEP`` more on every level. Pairs of
    nodes go down together: what their new bits differ in is added to what those above differed in, and a pair whose sum
    exceeds ``most`` is pruned with all below it. A pair of which both sides hold ``group_limit`` fingerprints at most stays.
    All of it is joins of nodes; nothing is collected.
    """
    out, level = [], 0
    if "turn" not in words.columns:
        words = words.withColumn("turn", F.lit(0))
    pairs = stored(words.groupBy("turn", _run(level, first).alias("a")).agg(F.count(F.lit(1)).alias("na")).select("turn", "a", F.col("a").alias("b"), F.lit(0).alias("seen"), "na", F.col("na").alias("nb")), "pairs")
    while True:
        small = (F.col("na") <= group_limit) & (F.col("nb") <= group_limit) if first + STEP * level < BITS else F.lit(True)
        out.append((level, pairs.filter(small).select("turn", "a", "b")))
        if pairs.filter(~small).isEmpty():
            return out
        level += 1
        bits = min(BITS, first + STEP * level)
        width = bits - first - STEP * (level - 1)
        nodes = stored(words.groupBy("turn", _run(level, first).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.shiftright("value", width) if bits < BITS else F.shiftrightunsigned("value", width)), "nodes")
        down = pairs.filter(~small).join(nodes.toDF("turn", "x", "nx", "a"), ["turn", "a"]).join(nodes.toDF("turn", "y", "ny", "b"), ["turn", "b"])
        seen = F.col("seen") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << width) - 1)))
        pairs = stored(down.filter("a < b or x <= y").withColumn("seen", seen).filter(F.col("seen") <= most).select("turn", F.col("x").alias("a"), F.col("y").alias("b"), "seen", F.col("nx").alias("na"), F.col("ny").alias("nb")), "pairs")


def _linked(batches: Iterator[pa.RecordBatch], most: int, turns: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of ``grouped`` in order: for each pair of nodes the edges of a forest of its links, turned back."""
    held: list[list[np.ndarray]] = []
    key = None

    def edges() -> pa.RecordBatch | None:
        side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        left, right = (fp[side == s].view(np.uint64) for s in (0, 1))
        if key[1] == key[2]:
            index = GrayIndex(left)
            root = forest(len(left), index.near(most))
            words = index.fp
        else:
            index = GrayIndex(right)
            words = np.concatenate([left, index.fp])
            root = forest(len(words), ((q, p + len(left)) for q, p in index.near(most, left)))
        at = np.flatnonzero(root != np.arange(len(root)))
        turn = key[0] // BITS * (BITS // turns)
        back = lambda x: (x >> np.uint64(turn)) | (x << np.uint64(-turn % BITS))
        return pa.RecordBatch.from_arrays([pa.array(back(x).view(np.int64)) for x in (words[at], words[root[at]])], ["a", "b"]) if len(at) else None

    for rows in batches:
        if not rows.num_rows:
            continue
        level, a, b, side, fp = (c.to_numpy(zero_copy_only=False) for c in rows.columns)
        cut = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (level[1:] != level[:-1])) + 1).tolist(), len(a)]
        for x, y in zip(cut, cut[1:]):  # noqa: B905
            own = (int(level[x]), int(a[x]), int(b[x]))
            if held and own != key:
                if (found := edges()) is not None:
                    yield found
                held = []
            key = own
            held.append([side[x:y].copy(), fp[x:y].copy()])
    if held and (found := edges()) is not None:
        yield found


def grouped(distinct: DataFrame, most: int, group_limit: int, turns: int = 1) -> DataFrame:
    """Rows (level, a, b, side, fp) of the pairs of nodes that stay; level tells the turn and the nodes' bits, fp is turned."""
    words, first = distinct.select(F.lit(0).alias("turn"), "fp"), 0
    if turns > 1:
        at = F.expr(f"turn * {BITS // turns}")
        turned = F.call_function("shiftleft", "fp", at).bitwiseOR(F.call_function("shiftrightunsigned", "fp", F.lit(BITS) - at))
        words = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")).select("turn", turned.alias("fp"))
        first = min(BITS // turns, (distinct.count() // FIRST).bit_length())
    met = []
    for level, pairs in surviving(words, most, group_limit, first):
        rows = words.withColumn("node", _run(level, first))
        for side, own in ((0, "a"), (1, "b")):
            some = pairs if not side else pairs.filter("a <> b")
            met.append(rows.join(some.withColumn("node", F.col(own)), ["turn", "node"]).select((F.col("turn") * BITS + level).alias("level"), "a", "b", F.lit(side).alias("side"), "fp"))
    return reduce(DataFrame.union, met)


def link_forest(distinct: DataFrame, most: int = 2, group_limit: int = 8192, turns: int = 1) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fp with at most so many differing bits.

    In one order a fingerprint goes to all nodes within reach, 42 of 64 and then 299 of 4096 at three bits, as the nodes get
    more. With ``turns`` over ``most`` there are as many orders, in each of which another part of the word comes first. Words
    within reach agree in one part wholly, so each order pairs its first nodes with themselves alone; only those over the
    limit go down in pairs.
    """
    if turns > 1 and (turns <= most or BITS % turns):
        raise ValueError("turns: 1, or a divisor of 64 over most")
    distinct = distinct.select("fp")
    rows = grouped(distinct, most, group_limit, turns).repartition("level", "a", "b").sortWithinPartitions("level", "a", "b", "side", "fp")
    return rows.mapInArrow(lambda it: _linked(it, most, turns), "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 2, width: int = 3, group_limit: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable by links."""
    marked = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = stored(components(link_forest(distinct, most, group_limit)), "roots")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
