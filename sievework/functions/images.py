"""Image metrics over decoded pixels, and arithmetic on landmarks and boxes.

Pixels come as height, width and bytes (RGB, or luma with one byte a pixel); decoding files needs Pillow, which is
optional. Reductions run in numpy on Arrow batches; landmarks and boxes stay columns.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

METRICS = StructType([StructField(n, DoubleType()) for n in ("blur", "exposure", "detail", "flesh", "mundane")])
# Weights of red, green and blue in luma; the band of skin tones; places of eyes and mouth in a face mesh.
LUMA = np.array([0.299, 0.587, 0.114])
SKIN = {"hue": (3.0, 50.0), "saturation": (0.08, 0.90), "value": 0.12}
LEFT_EYE, RIGHT_EYE = (362, 385, 387, 263, 373, 380), (33, 160, 158, 133, 153, 144)
MOUTH = {"left": 61, "right": 291, "upper": 13}


def laplacian_variance(luma: np.ndarray) -> float:
    c = luma.astype(np.float64)
    if min(c.shape) < 3:
        return 0.0
    return float((c[1:-1, :-2] + c[1:-1, 2:] + c[:-2, 1:-1] + c[2:, 1:-1] - 4 * c[1:-1, 1:-1]).var())


def hue_saturation(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue in degrees and saturation of pixels in [0, 1]; grey has hue 0."""
    top, low = rgb.max(-1), rgb.min(-1)
    d = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(rgb, -1, 0)
    sector = np.select([top == b, top == g], [(r - g) / d + 4, (b - r) / d + 2], (g - b) / d % 6)
    return np.where(top > low, 60 * sector, 0.0) % 360, np.where(top > 0, (top - low) / np.maximum(top, 1e-6), 0.0)


def flesh_share(rgb: np.ndarray) -> float:
    hue, sat = hue_saturation(rgb)
    inside = lambda x, k: (x >= SKIN[k][0]) & (x <= SKIN[k][1])
    return float((inside(hue, "hue") & inside(sat, "saturation") & (rgb.max(-1) >= SKIN["value"])).mean())


def mundane_share(rgb: np.ndarray, flesh: float) -> float:
    """How plain a picture is: few hues, even blocks, little colour; skin speaks against it."""
    hue, sat = hue_saturation(rgb)
    p = np.bincount(np.minimum((hue / 360 * 32).astype(int), 31).ravel(), minlength=32) / hue.size
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    h, w = (max(n // 4, 1) for n in hue.shape)
    cells = [c.mean((0, 1)) for i in range(4) for j in range(4) if (c := rgb[i * h : (i + 1) * h, j * w : (j + 1) * w]).size]
    spread = np.square(np.array(cells) - np.mean(cells, 0)).sum(1).mean()
    parts = (0.5, 1 - entropy / 5), (0.3, 1 - spread / 8000), (0.2, 1 - 5 * sat.mean())
    base = float(np.clip(sum(k * np.clip(x, 0, 1) for k, x in parts), 0, 1))
    return max(base - 3 * flesh, 0.0) if flesh > 0.03 else base


def measure(height: int, width: int, pixels: bytes) -> tuple:
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, -1)
    luma = (x[:, :, 0] if x.shape[2] == 1 else np.rint(x @ LUMA)).astype(np.float64)
    rgb = np.repeat(x, 3, 2) / 255 if x.shape[2] == 1 else x / 255
    flesh = flesh_share(rgb)
    return laplacian_variance(luma), float(luma.mean() / 255), float(luma.std()), flesh, mundane_share(rgb, flesh)


@F.pandas_udf(METRICS)
def image_metrics(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    """blur, exposure, detail, flesh and mundane of each image; all null without pixels."""
    rows = [measure(int(h), int(w), bytes(p)) if p is not None and len(p) else (None,) * 5 for h, w, p in zip(height, width, pixels, strict=True)]
    return pd.DataFrame(rows, columns=METRICS.names, dtype="float64")


def decode(content: bytes, most: int = 512) -> tuple[int, int, bytes] | None:
    """Height, width and RGB of an image file at most so large; None where it can't be read or Pillow is missing."""
    try:
        from PIL import Image, ImageOps

        img = ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB")
        img.thumbnail((most, most), Image.BILINEAR)
    except (ImportError, OSError, ValueError):
        return None
    return img.height, img.width, img.tobytes()


def eye_ratio(points: Column, at: tuple[int, ...]) -> Column:
    """Openness of an eye of six landmarks (array of structs x, y), given their places from 0."""
    p = [F.get(points, F.lit(i)) for i in at]
    return (F.abs(p[1]["y"] - p[5]["y"]) + F.abs(p[2]["y"] - p[4]["y"])) / (2 * F.abs(p[0]["x"] - p[3]["x"]) + 1e-8)


def sentiment(points: Column, left=LEFT_EYE, right=RIGHT_EYE, mouth=MOUTH) -> Column:
    """0.55 * open eyes + 0.45 * smile of one face; 0.5 without landmarks."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    eyes = clip((eye_ratio(points, left) + eye_ratio(points, right)) / 2 / 0.2)
    y = {k: F.get(points, F.lit(i))["y"] for k, i in mouth.items()}
    smile = clip((y["upper"] - (y["left"] + y["right"]) / 2) * 25 + 0.5)
    return F.coalesce(0.55 * eyes + 0.45 * smile, F.lit(0.5))


def face_summary(boxes: Column, image_area: Column, least_p: float = 0.80, least_share: float = 0.05) -> Column:
    """count, prominence and confidence of boxes (array of structs area, p) that are sure and large enough."""
    good = F.filter(boxes, lambda b: (b["p"] >= least_p) & (b["area"] >= image_area * least_share))
    total = lambda k: F.aggregate(good, F.lit(0.0), lambda s, b: s + b[k])
    n = F.size(good)
    return F.struct(n.alias("count"), F.least(F.lit(1.0), total("area") / image_area).alias("prominence"), F.when(n > 0, total("p") / n).otherwise(0.0).alias("confidence"))


def shrink(luma: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of about equal blocks; a smaller image repeats its pixels."""
    rows, cols = ((np.arange(n) * size / n).astype(int) for n, size in ((height, luma.shape[0]), (width, luma.shape[1])))
    if luma.shape[0] < height or luma.shape[1] < width:
        return luma[np.ix_(rows, cols)].astype(np.float64)
    total = np.add.reduceat(np.add.reduceat(luma.astype(np.float64), rows, 0), cols, 1)
    return total / np.outer(np.diff([*rows, luma.shape[0]]), np.diff([*cols, luma.shape[1]]))


def cosine_basis(n: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(n), 2 * np.arange(n) + 1) / (2 * n))


def sketch(luma: np.ndarray, kind: str = "phash") -> str:
    """A 64-bit sketch as 16 hex digits: ahash above the mean, dhash rising to the right, phash low cosine terms above their median."""
    if kind == "ahash":
        x = shrink(luma, 8, 8)
        bits = x > x.mean()
    elif kind == "dhash":
        x = shrink(luma, 8, 9)
        bits = x[:, 1:] > x[:, :-1]
    else:
        b = cosine_basis(32)
        x = (b @ shrink(luma, 32, 32) @ b.T)[:8, :8]
        bits = x > np.median(x)
    return f"{int(''.join('01'[int(v)] for v in bits.ravel()), 2):016x}"
