"""Capture times from file names and EXIF offsets, as columns.

A name may hold several shapes of a time. Each shape is one projection that lists its matches and keeps the plausible
ones; the first match of the most exact shape counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import stem

# The shapes of dates and times in file names, and the ranges that count as plausible.
FULL = r"(?<!\d)((?:19|20)\d{12})(?:\d{3})?(?!\d)"
MINUTES = r"(?<!\d)((?:19|20)\d{10})(?!\d)"
DATE = r"(?<!\d)((?:19|20)\d{2}[-_.]?\d{2}[-_.]?\d{2})(?!\d)(?=(.*))"
TIME = r"^\D{0,6}(\d{1,2})[-_:.\s]?(\d{2})[-_:.\s]?(\d{2})(?:\d{3})?(?!\d)(?:\s*([AaPp])[Mm])?"
SHORT_TIME = r"^[-_:.\sT]+(?:(\d{2})(\d{2})|(\d{1,2})[-_:.](\d{2}))(?!\d)"
SEQUENCES = (r"[Ww][Aa](\d{1,4})", r"\((\d{1,4})\)", r"[_-](\d{1,4})(?=\D|$)")
EPOCH = r"(?<!\d)(\d{13}|\d{10})(?!\d)"
FIRST_YEAR, LAST_YEAR = 1990, 2100
FIRST_EPOCH, LAST_EPOCH = 946_684_800, 4_102_444_800
NOON = 12 * 3600


def _number(text: Column, start: int, size: int) -> Column:
    return F.substring(text, start, size).cast("int")


def _epoch(digits: Column, places: int) -> Column:
    """Seconds of yyyyMMdd, then HH, mm and ss as far as places go; null for what no calendar has or years out of range."""
    part = lambda at: _number(digits, at, 2) if at < places else F.lit(0)
    year = _number(digits, 1, 4)
    when = F.try_make_timestamp_ntz(year, part(5), part(7), part(9), part(11), part(13).cast("decimal(16,6)"))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), when)
    return F.when(year.between(FIRST_YEAR, LAST_YEAR) & (part(13) < 60), seconds.cast("double"))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def captured(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with UTC epoch seconds of the first plausible time in a file name, the most exact shape first; 0 without one."""
    x = df.withColumn("_stem", F.coalesce(stem(F.col(name)), F.lit("")))
    each = lambda pattern, group: F.regexp_extract_all("_stem", F.lit(pattern), F.lit(group))
    first = lambda times: F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))
    x = x.withColumn("_14", first(F.transform(each(FULL, 1), lambda m: _epoch(m, 14))))
    x = x.withColumn("_12", first(F.transform(each(MINUTES, 1), lambda m: _epoch(m, 12))))
    days = F.zip_with(each(DATE, 1), each(DATE, 2), lambda d, rest: F.struct(_epoch(F.regexp_replace(d, "[-_.]", ""), 8).alias("day"), rest.alias("rest")))
    x = x.withColumn("_day", F.get(F.filter(days, lambda d: d["day"].isNotNull()), F.lit(0)))
    x = x.withColumns({"_rest": F.col("_day.rest"), "_day": F.col("_day.day")})
    x = x.withColumns({"_h": _found(F.col("_rest"), TIME, 1).cast("int"), "_half": F.lower(F.regexp_extract("_rest", TIME, 4))})
    hour = F.when((F.col("_half") != "") & F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0)).otherwise(F.col("_h"))
    x = x.withColumns({"_h": hour, "_m": _found(F.col("_rest"), TIME, 2).cast("int"), "_s": _found(F.col("_rest"), TIME, 3).cast("int")})
    x = x.withColumns({f"_{k}": F.coalesce(_found(F.col("_rest"), SHORT_TIME, i), _found(F.col("_rest"), SHORT_TIME, i + 2)).cast("int") for k, i in (("h2", 1), ("m2", 2))})
    exact = F.when((F.col("_h") < 24) & (F.col("_m") < 60) & (F.col("_s") < 60), F.col("_h") * 3600 + F.col("_m") * 60 + F.col("_s"))
    short = F.when((F.col("_h2") < 24) & (F.col("_m2") < 60), F.col("_h2") * 3600 + F.col("_m2") * 60)
    number = F.coalesce(*(_found(F.col("_rest"), p, 1).cast("int") for p in SEQUENCES), F.lit(0))
    clock = F.coalesce(exact, short, NOON + F.when(number < 60, number).otherwise(0))
    digits = F.regexp_extract("_stem", EPOCH, 1)
    stamp = F.when(digits.startswith("1"), digits.cast("double") / F.when(F.length(digits) == 13, 1000.0).otherwise(1.0))
    since = F.when(stamp.between(FIRST_EPOCH, LAST_EPOCH), stamp)
    return x.withColumn(out, F.coalesce("_14", "_12", F.col("_day") + clock, since, F.lit(0.0))).drop("_stem", "_14", "_12", "_day", "_rest", "_h", "_half", "_m", "_s", "_h2", "_m2")


def exif_offset_minutes(s: Column) -> Column:
    """Minutes of Z or a signed HH:MM, in any case and with space around; null where malformed, beyond 14:00, or with 60 minutes and more."""
    own = F.upper(F.trim(s))
    h, m = F.regexp_extract(own, r"^[+-](\d{2}):?(\d{2})$", 1), F.regexp_extract(own, r"^[+-](\d{2}):?(\d{2})$", 2)
    n = h.try_cast("int") * 60 + m.try_cast("int")
    return F.when(own == "Z", 0).when((h != "") & (m.try_cast("int") < 60) & (n <= 14 * 60), F.when(own.startswith("-"), -n).otherwise(n))
