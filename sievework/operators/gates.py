"""Gates: predicates on items, the ordered chain with its reason, and the replay on stored values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import haversine_km, leaf, stem

# Common screen sizes, and what reshared files' names begin with.
SCREENS = (
    (1080, 1920), (1080, 2160), (1080, 2340), (1080, 2400), (1080, 2640), (1170, 2532), (1179, 2556), (1284, 2778),
    (1290, 2796), (828, 1792), (750, 1334), (1440, 3040), (1440, 3200), (1080, 2280), (1080, 2408), (2560, 1440),
    (1920, 1080), (2560, 1600), (3840, 2160), (3024, 1964), (2880, 1800), (2560, 1664), (1366, 768),
)
RESHARED = ("fb_img_", "img-wa", "whatsapp", "received_", "screenshot", "screen shot", "insta_", "twitter_", "tweet_", "telegram_", "viber image", "signal-")
NUMERIC_STEM = r"^[0-9]{10,13}([-_][0-9]+)?$"


def screenshot(width: Column, height: Column, camera: Column, gps: Column) -> Column:
    shaped = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h")).isin(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for a, b in SCREENS for w, h in ((a, b), (b, a))))
    return (gps == 0) & (F.trim(F.coalesce(camera, F.lit(""))) == "") & shaped


def closeup(flesh: Column, blur: Column) -> Column:
    return (flesh >= 0) & (flesh >= 0.65) & (blur <= 120)


def pitch(detail: Column, exposure: Column) -> Column:
    return (detail >= 0) & (detail < 2) & ((exposure < 0.05) | (exposure > 0.95))


def home_private(lat: Column, lon: Column, faces: Column, home: tuple[float, float] | None, radius_km: float) -> Column:
    if home is None:
        return F.lit(False)
    return ~((lat == 0) & (lon == 0)) & (haversine_km(lat, lon, F.lit(home[0]), F.lit(home[1])) <= radius_km) & (faces <= 1)


def rare_location(lat: Column, lon: Column, home: tuple[float, float] | None, radius_km: float) -> Column:
    away = F.lit(True) if home is None else haversine_km(lat, lon, F.lit(home[0]), F.lit(home[1])) > radius_km
    return ~((lat == 0) & (lon == 0)) & away


def reshared(path: Column, prefixes: tuple[str, ...] = RESHARED) -> Column:
    name = F.lower(leaf(path))
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | name.startswith(p)
    return begins | stem(path).rlike(NUMERIC_STEM)


def quality(blur: Column, exposure: Column, resolution: Column) -> Column:
    return (blur >= 50) & exposure.between(0.15, 0.90) & (resolution >= 640)


def first_reason(*gates: tuple[str, Column | None]) -> Column:
    """The name of the first gate that holds, '' if none does; a gate given as None is switched off and leaves the plan."""
    chain = None
    for name, holds in gates:
        if holds is not None:
            chain = F.when(holds, name) if chain is None else chain.when(holds, name)
    return F.lit("") if chain is None else chain.otherwise("")


def privacy_reason(home: tuple[float, float] | None, radius_km: float, off: frozenset[str] = frozenset()) -> Column:
    """The full chain over an item's columns; gates named in ``off`` leave the plan.

    What vectors tell comes as boolean columns: document, text_heavy, document_page, boring, mundane, intimate; ``page_like``
    and ``plainness`` come from pixels. A document page is looked for only where text-heavy items are and a vector is there;
    how plain a picture is counts only without one.
    """
    c, seen = F.col, F.col("clip_emb").isNotNull()
    gates: dict[str, Column] = {
        "reshared_filename": reshared(c("path")),
        "screenshot": screenshot(c("width"), c("height"), c("camera_model"), c("has_gps")),
        "accidental_closeup": closeup(c("flesh_fraction"), c("blur_score")),
        "pitch_black_or_pure_white": pitch(c("detail_stddev"), c("exposure_score")),
        "home_private": home_private(c("lat"), c("lon"), c("face_count"), home, radius_km),
        "document": seen & c("document"),
        "text_heavy": seen & c("text_heavy"),
        "text_document_page": seen & c("document_page") & c("page_like"),
        "boring_object": seen & c("boring"),
        "mundane_object": seen & c("mundane"),
        "mundane_heuristic": ~seen & (c("plainness") >= 0.80) & (c("detail_stddev") < 12) & (c("face_count") == 0),
        "intimate_content": seen & c("intimate"),
    }
    if "text_heavy" in off:
        off |= {"text_document_page"}
    return first_reason(*((name, None if name in off else holds) for name, holds in gates.items()))


def cached_reason() -> Column:
    """The chain that stored values can answer, for items with a vector."""
    c = F.col
    return first_reason(
        ("reshared_filename", reshared(c("path"))), ("accidental_closeup", closeup(c("flesh_fraction"), c("blur_score"))), ("pitch_black_or_pure_white", pitch(c("detail_stddev"), c("exposure_score"))),
        ("document", c("document")), ("text_heavy", c("text_heavy")), ("mundane_object", c("boring") | c("mundane")), ("intimate_content", c("intimate")),
    )


def reassess(items: DataFrame, reason: Column, previous: Column) -> DataFrame:
    """New flag and reason from stored values; rows without vector keep theirs.

    A private row that no gate confirms is cleared where a camera, a place or a face speaks for it, else it stays.
    """
    speaks = (F.trim("camera_model") != "") | (F.col("has_gps") > 0) | (F.col("face_count") > 0)
    kept = F.when(previous == "", "preserved_from_ingest").otherwise(previous)
    flag = F.when(F.col("clip_emb").isNull(), F.col("is_private")).when(reason != "", 1).when((F.col("is_private") == 1) & ~speaks, 1).otherwise(0)
    why = F.when(F.col("clip_emb").isNull(), previous).when(reason != "", reason).when((F.col("is_private") == 1) & ~speaks, kept).otherwise("")
    return items.withColumns({"new_private": flag.cast("int"), "new_reason": why, "flipped": (flag != F.col("is_private")).cast("int")})
