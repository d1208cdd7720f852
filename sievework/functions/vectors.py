"""Columns over vectors (arrays of numbers), in double precision; products with many prompts are one matrix product a batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is below 1e-8."""
    return F.when((norm(a) < 1e-8) | (norm(b) < 1e-8), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def usable(a: Column, least: float = 1e-6) -> Column:
    return a.isNotNull() & (F.size(a) > 0) & (norm(a) >= least)


def dots(v: Column, prompts: Sequence[Sequence[float]]) -> Column:
    """The products of each vector with all prompts, as one matrix product a batch; null for vectors of another width."""
    m = np.array(prompts, np.float64)

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        at = [i for i, x in enumerate(vectors) if x is not None and len(x) == m.shape[1]]
        if at:
            for i, x in zip(at, np.stack([vectors.iloc[i] for i in at]).astype(np.float64) @ m.T, strict=True):
                out[i] = x
        return pd.Series(out, dtype=object)

    return run(v)


def with_shares(df: DataFrame, scores: Column, out: str = "shares", scale: float = 100.0) -> DataFrame:
    """df with the shares exp(scale * (x - max)) of an array of scores.

    Scores, their maximum and the sum are columns of their own: inside a lambda they would be worked out per element.
    """
    x = df.withColumn("_s", scores).withColumn("_top", F.array_max("_s"))
    x = x.withColumn("_e", F.transform("_s", lambda s: F.exp(F.lit(scale) * (s - F.col("_top")))))
    x = x.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda s, y: s + y))
    return x.withColumn(out, F.transform("_e", lambda y: y / F.col("_sum"))).drop("_s", "_top", "_e", "_sum")


def with_binary_max(df: DataFrame, v: Column, variants: Sequence[Sequence[float]], baseline: Sequence[float], out: str, scale: float = 100.0) -> DataFrame:
    """df with the largest share of a variant against the baseline alone."""
    x = df.withColumns({"_base": dot(v, literal(baseline)), "_top": F.array_max(dots(v, variants))})
    return x.withColumn(out, 1 / (1 + F.exp(F.lit(scale) * (F.col("_base") - F.col("_top"))))).drop("_base", "_top")


def private_by(p: Column, threshold: float, ratio: float) -> Column:
    """p: shares with the normal class last. The largest other one exceeds the threshold and ratio times the normal one."""
    top = F.array_max(F.slice(p, 1, F.size(p) - 1))
    return (top > threshold) & (top >= ratio * F.greatest(F.element_at(p, -1), F.lit(1e-6)))


def aesthetic(v: Column, positive: Sequence[float], negative: Sequence[float]) -> Column:
    """(pos - neg + 2) / 4 within 0 and 1; 0.5 without a vector."""
    x = (dot(v, literal(positive)) - dot(v, literal(negative)) + 2) / 4
    return F.when(v.isNull(), 0.5).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def sign_bits(v: Column, kind: str) -> Column:
    """A 64-bit sketch of 64 components, as a signed number: above the mean, above the median, or below the next one."""
    d = doubles(v)
    if kind == "ahash":
        mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
        flags = F.transform(d, lambda x: x > mean)
    elif kind == "phash":
        s = F.array_sort(d)
        middle = (F.element_at(s, F.lit(32)) + F.element_at(s, F.lit(33))) / 2
        flags = F.transform(d, lambda x: x > middle)
    else:
        flags = F.zip_with(d, F.slice(d, 2, 64), lambda x, y: F.coalesce(x < y, F.lit(False)))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, f: F.shiftleft(acc, 1).bitwiseOR(f.cast("long")))
