"""What EXIF holds, as columns: rational numbers, positions, and times of capture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text_time import exif_offset_minutes


def rational(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is."""
    return F.when(denominator == 0, 0.0).otherwise(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    """Degrees of a position; south and west are negative, missing parts give NaN."""
    d = degrees + minutes / 60 + seconds / 3600
    return F.coalesce(F.when(F.upper(F.trim(reference)).isin("S", "W"), -d).otherwise(d), F.lit(float("nan")))


def capture_time(original: Column, changed: Column, offset: Column) -> Column:
    """UTC epoch seconds of DateTimeOriginal, else of DateTime, less the offset where one is told; null where neither is a time."""

    def seconds(text: Column) -> Column:
        part = lambda at, n: F.substring(own, at, n).try_cast("int")
        own = F.regexp_extract(F.trim(text), r"^(\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2})\x00*$", 1)
        when = F.try_make_timestamp_ntz(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2).cast("decimal(16,6)"))
        return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), when).cast("double")

    return F.coalesce(seconds(original), seconds(changed)) - 60 * F.coalesce(exif_offset_minutes(offset), F.lit(0))
