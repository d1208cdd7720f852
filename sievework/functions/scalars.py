"""Scalar columns: geography, scores, sizes, hashes and report formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def face_score(n: Column, prominence: Column, most: int = 6) -> Column:
    size = F.least(F.lit(1.0), F.log(n + F.lit(1.0)) / F.lit(math.log(most + 1)))
    return F.when(n <= 0, 0.0).otherwise(0.65 * size + 0.35 * F.least(F.lit(1.0), prominence * 3))


def bytes_estimate(long_side: int = 2560, quality: int = 92) -> int:
    per_pixel = next(b for q, b in ((95, 3.5), (90, 2.5), (85, 1.5), (75, 1.0), (-1, 0.5)) if quality >= q)
    return int(long_side * (long_side * 0.75) * per_pixel / 8)


def est_size(size: Column, resize: bool = True, long_side: int = 2560, quality: int = 92) -> Column:
    """The estimated output size; sizes of 0 or null count as 2 MB."""
    return F.least(F.coalesce(F.nullif(size, F.lit(0)), F.lit(2_000_000)), F.lit(bytes_estimate(long_side, quality) if resize else 8_000_000))


def hash_matches(cached: Column, sha: Column, md5: Column) -> Column:
    return F.when(F.length(cached) == 64, cached == sha).when(F.length(cached) == 32, cached == md5).otherwise(False)


def hex_bits(h: Column) -> Column:
    """A 16-digit hash as a number; null where it isn't one."""
    return F.when(h.rlike("^[0-9a-f]{16}$"), F.conv(h, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; 64 where one is empty, malformed or of another length."""
    return F.coalesce(F.bit_count(hex_bits(a).bitwiseXOR(hex_bits(b))), F.lit(64))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(leaf(path), r"\.[^.]*$", "")


def minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-8, 0.5).otherwise((x - low) / (high - low))
