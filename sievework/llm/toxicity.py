"""Toxicity by non-negative positive-unlabelled learning in numpy.

Confirmed toxic texts are the positives; texts at large, whatever their labels say, are the unlabelled ones. A word and
its first letters are features. Those that mark positives out against the document frequencies of all training texts
are kept, and a linear model over their presence minimises the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid loss.

Bounded samples (documented parameters of ``learn``): ``most_positive`` confirmed positives give the candidate features,
and they and ``most_unlabelled`` texts fit the weights, both chosen by a hash of the id. Document frequencies, the class
prior and the scores cover all rows.

Defined cases: null text is empty; an empty text has the score of no features; repeated rows are scored each; of
repeated or contradicting labels one toxic row suffices; without any confirmed positive every score is 0; a null doc_id
counts as the empty text for the hash and has no label; other columns pass through ``scored`` or are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import remainder, table

PREFIXES = (4, 5, 6)
FOLDS = 5
find_words = re.compile(r"[^\W\d_]+").findall
#: Words a Python worker remembers the features of; beyond it the memory is emptied.
REMEMBERED = 200_000


def features_of(word: str) -> tuple[int, ...]:
    """Numbers for the word and its first letters; they are CRC-32 values of distinct texts."""
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) for x in (f"={word}", *(f"{n}^{word[:n]}" for n in PREFIXES if len(word) >= n)))


class Reader:
    """Turns texts into the positions, in a sorted array, of the features they have."""

    def __init__(self, chosen: np.ndarray | None):
        self.place = None if chosen is None else {int(f): i for i, f in enumerate(chosen)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        own = set(find_words(text.lower()))
        for w in own.difference(self.known):
            f = features_of(w)
            self.known[w] = f if self.place is None else tuple(self.place[x] for x in f if x in self.place)
        return set().union(*map(self.known.__getitem__, own))


def _counts(texts: DataFrame, chosen: np.ndarray | None) -> DataFrame:
    """(feature, n): in how many texts each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = Reader(chosen), {}
        for b in batches:
            for t in b.column(0):
                for f in read(t.as_py() or ""):
                    counts[f] = counts.get(f, 0) + 1
            if len(counts) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])
                counts = {}
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _rows(texts: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(chosen)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(read(t.as_py() or "")) for t in b.column(0)], pa.list_(pa.int32()))], ["x"])

    return [np.asarray(x, np.int32) for x in texts.select("text").mapInArrow(run, "x array<int>").toArrow().column(0).to_pylist()]


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def score(self, x) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, x))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


class _Sparse:
    """Rows of feature positions: margins and gradients by sums over segments."""

    def __init__(self, rows: list[np.ndarray]):
        self.n, self.flat = len(rows), np.concatenate([*rows, np.zeros(0, np.int32)])
        self.row = np.repeat(np.arange(self.n), [len(x) for x in rows])

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.row, w[self.flat], self.n)

    def gradient(self, d: np.ndarray, size: int) -> np.ndarray:
        return np.append(np.bincount(self.flat, d[self.row], size), d.sum()) / max(1, self.n)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; where it turns negative, only its negative part is undone."""
    p, u = _Sparse(positive), _Sparse(unlabelled)
    v = np.zeros(size + 1)
    v[-1] = -1.0
    m, s = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, steps + 1):
        zp, zu = p.margins(v[:-1], v[-1]), u.margins(v[:-1], v[-1])
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        # The loss of a label y is sigmoid(-y z): R(+) = mean(1 - s), R(-) = mean(s).
        negative = p.gradient(sp * (1 - sp), size) * -prior + u.gradient(su * (1 - su), size)
        if su.mean() - prior * sp.mean() >= 0:
            g = negative - prior * p.gradient(sp * (1 - sp), size)
        else:
            g = -negative
        g[:-1] += decay * v[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return v[:-1], float(v[-1])


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most_positive: int = 10_000, most_unlabelled: int = 30_000, least_ratio: float = 3.0, least_z: float = 4.0) -> Model:
    """A model from the rows of docs and labels whose remainder by folds is not 0 (all rows where folds is 0)."""
    spark = docs.sparkSession
    inside = lambda df: df.filter(remainder("doc_id", folds) != 0) if folds else df
    known = inside(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not n_toxic:
        return Model()
    chosen_by = lambda df, most: df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = inside(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # Both id lists are bounded by their limits.
    some = lambda ids: texts.join(F.broadcast(spark.createDataFrame([tuple(r) for r in ids.collect()], "doc_id long")), "doc_id", "left_semi")
    positive = some(chosen_by(known.filter("toxic = 1"), most_positive))
    n_positive = min(n_toxic, most_positive)
    # A feature of a given share of the positives: their number is bounded by the features of a text over that share.
    candidates = _counts(positive, None).filter(F.col("n") >= max(3, n_positive // 1000)).toArrow()
    place = np.argsort(f := candidates.column(0).to_numpy())
    f, in_positive = f[place], candidates.column(1).to_numpy()[place]
    if not len(f):
        return Model()
    found = _counts(texts, f).toArrow()
    in_all = np.zeros(len(f))
    in_all[found.column(0).to_numpy()] = found.column(1).to_numpy()
    n_texts = texts.select("doc_id").count()
    a, b = in_positive / n_positive, in_all / max(1, n_texts)
    both = (in_positive + in_all) / (n_positive + n_texts)
    z = (a - b) / np.sqrt(both * (1 - both) * (1 / n_positive + 1 / max(1, n_texts)) + 1e-12)
    f = f[(a >= least_ratio * b) & (z >= least_z)]
    if not len(f):
        return Model()
    unlabelled = some(chosen_by(texts.filter("doc_id is not null"), most_unlabelled))
    weights, bias = fit(_rows(positive, f), _rows(unlabelled, f), n_toxic / n, len(f))
    return Model(f, weights, bias)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the column score at the end (it replaces one of that name)."""
    docs = docs.drop(score)
    at, names = docs.columns.index(text), [*docs.columns, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model.features)
        for b in batches:
            out = [model.score(read(t.as_py() or "")) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names)

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(score)).schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
