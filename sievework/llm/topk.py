"""Exact top-k by inner product: branch and bound over the dimensions of a columnar layout.

Queries and candidates meet in blocks of bounded size. Both are turned to the principal axes of all vectors, so that the
first dimensions hold most of the mass. In a block the partial products of a few dimensions at a time are added up; what is
left of a pair is bounded by the product of the remaining norms, and pairs whose bound is below the k-th best score
known are dropped: candidates that no query needs leave the layout, and once few pairs are left these go on alone. Each
query brings a lower bound of its k-th best score from a first block of candidates to all others. Bounds are kept loose by more
than any rounding; what survives is scored again in whole numbers, so the result is exact.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; shorter
vectors count as filled up with zeros; repeated rows, of one id or equal ones, are rows of their own: each is a candidate of the others, and
each with a query id is a query; ties go to the smaller id, and repeated ids come in any order; scores beyond a long are
held at its ends; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import stored, table

EXACT = float(1 << 53)


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow array of lists, filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    width = int(size.max(initial=0))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _choose(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best rows: highest score, then smallest id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - begin < k]


class Columnar:
    """Candidates by dimension along the given axes, with the norms of what is left behind every cut."""

    def __init__(self, c: np.ndarray, axes: np.ndarray, width: int = 8):
        self.whole, self.axes = c, axes
        d = len(axes)
        self.cuts = [*range(0, d, width), d]
        turned = c @ axes
        self.columns = np.ascontiguousarray(turned.T, np.float32)
        self.left = self.rest(turned)

    def rest(self, turned: np.ndarray) -> np.ndarray:
        tail = np.cumsum(np.square(turned[:, ::-1]), 1)[:, ::-1]
        return np.sqrt(np.stack([*(tail[:, a] for a in self.cuts[:-1]), np.zeros(len(turned))])).astype(np.float32)


def kth_best(q: np.ndarray, c: np.ndarray, k: int, together: int = 512) -> np.ndarray:
    """A lower bound of each query's k-th best score: its k+1-th best among c, as one of them may be the query itself."""
    if len(c) <= k:
        return np.full(len(q), -np.inf)
    return np.concatenate([np.partition(q[a : a + together] @ c.T, len(c) - k - 1, axis=1)[:, -k - 1] for a in range(0, len(q), together)] or [np.zeros(0)])


def bounded(q_rows: np.ndarray, q: np.ndarray, least: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: Columnar, k: int, together: int = 256, told: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, candidate id, score) of each query's k best candidates that are other rows, among those that reach ``least``.

    ``told`` gathers the pairs that were open after each cut.
    """
    found = []
    turned = q @ c.axes
    q_left, part32 = c.rest(turned), turned.astype(np.float32)
    q_norm, c_norm = q_left[0], float(c.left[0].max(initial=0))
    for a in range(0, len(q), together):
        some = slice(a, min(len(q), a + together))
        # Looser than single precision rounds: the sums stay below the product of the norms.
        floor = (least[some] - 1e-5 * (1 + q_norm[some] * c_norm)).astype(np.float32)
        alive = np.flatnonzero(c.left[0] * q_norm[some].max(initial=0) >= floor.min(initial=np.inf))  # whole groups whose norms are too small
        sums, x, y = np.zeros((some.stop - a, len(alive)), np.float32), None, None
        for step in range(len(c.cuts) - 1):
            lo, hi = c.cuts[step], c.cuts[step + 1]
            columns = c.columns[lo:hi] if len(alive) == len(c_rows) else c.columns[lo:hi, alive]
            sums += part32[some, lo:hi] @ columns
            if hi < len(c.axes) and hi * 3 < len(c.axes):
                continue  # too early for the bounds to tell
            open_ = sums + q_left[step + 1][some][:, None] * c.left[step + 1][alive] >= floor[:, None]
            n = int(np.count_nonzero(open_))
            if told is not None:
                told[hi] = told.get(hi, 0) + n
            if n * 16 < open_.size or hi == len(c.axes):  # few pairs are left: these go on alone
                x, y = np.nonzero(open_)
                break
            keep = open_.any(0)
            if np.count_nonzero(keep) < 0.8 * len(alive):
                alive, sums = alive[keep], np.ascontiguousarray(sums[:, keep])
        if x is None:
            continue
        y = alive[y]
        score = np.concatenate([np.einsum("pd,pd->p", q[a + x[i : i + 65536]], c.whole[y[i : i + 65536]]) for i in range(0, len(x), 65536)] or [np.zeros(0)])
        real = q_rows[a + x] != c_rows[y]
        real &= score >= least[a + x]
        x, y, score = x[real], y[real], score[real]
        best = _choose(x, c_ids[y], score, k)
        found.append((q_rows[a + x[best]], c_rows[y[best]], c_ids[y[best]], score[best].astype(np.int64)))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _large(q_rows, q, c_rows, c_ids, c, k):
    """Components beyond double precision: whole numbers of any size."""
    whole = lambda x: [[int(v) for v in row] for row in x]
    out, cs = [], whole(c)
    for i, v in zip(q_rows.tolist(), whole(q), strict=True):
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, r) for r, j, w in zip(c_rows.tolist(), c_ids.tolist(), cs, strict=True) if r != i)[:k]
        out += [(i, r, j, max(-(1 << 63), min((1 << 63) - 1, -x))) for x, j, r in s]
    return tuple(np.array([o[n] for o in out], np.int64) for n in range(4))


def scaled(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """(vec_id, v): v the floors of factor * component, for rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.asarray(lists.value_lengths())
            flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = bad[ends] == bad[ends - size]
            if fine.any():
                values = np.floor(factor * flat[np.repeat(fine, size)])
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fine)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[fine])]), pa.int32()), pa.array(values))], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v array<double>")


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """The axes of all vectors' second moments, largest first; the driver gets one matrix of width x width a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = padded(matrix(b.column(0)), width)
            x = x / np.abs(x).max(initial=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["i", "x"])

    moments = rows.select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros(width * width)
    m[moments.column("i").to_numpy()] = moments.column("x").to_numpy()
    return np.linalg.eigh(m.reshape(width, width))[1][:, ::-1].copy()


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all rows.

    Both sides are dealt to blocks by a hash; every pair of blocks is one task's work, whatever the data.
    """
    rows = stored(scaled(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, nq, width, top = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not nq:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_c, n_q = -(-n // candidate_block), -(-nq // query_block)
    exact = (width or 0) * (top or 0.0) ** 2 < EXACT
    axes = principal_axes(rows, width) if width and exact else np.zeros((0, 0))
    spread = lambda x, blocks: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("qb", spread("row", n_q))
    dealt = rows.withColumn("cb", spread("row", n_c))
    side = lambda t: (t.column("row").to_numpy(), padded(matrix(t.column("v")), width))

    def first(q: pa.Table, c: pa.Table) -> pa.Table:
        (q_rows, x), (_, y) = side(q), side(c)
        return pa.table({"row": q_rows, "least": kth_best(x, y, k)}) if len(q_rows) else pa.table({"row": pa.array([], pa.int64()), "least": pa.array([], pa.float64())})

    if exact and width:
        some = dealt.filter("cb = 0").withColumn("qb", each(n_q))
        least = queries.groupBy("qb").cogroup(some.groupBy("qb")).applyInArrow(first, "row long, least double")
        queries = stored(queries.join(least, "row"), "queries")
    else:
        queries = queries.withColumn("least", F.lit(float("-inf")))
    left, right = queries.select("row", "v", "least", "qb", each(n_c).alias("cb")), dealt.select("row", "vec_id", "v", "cb", each(n_q).alias("qb"))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 4
        if q.num_rows and c.num_rows:
            (q_rows, x), (c_rows, y), ids = side(q), side(c), c.column("vec_id").to_numpy()
            found = bounded(q_rows, x, q.column("least").to_numpy(), c_rows, ids, Columnar(y, axes), k) if len(axes) else _large(q_rows, x, c_rows, ids, y, k)
        return pa.table({name: pa.array(v, pa.int64()) for name, v in zip(("query", "row", "vec_id", "score"), found, strict=True)})

    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, "query long, row long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(rows.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
