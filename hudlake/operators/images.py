"""Crops and masks of screenshots, on NumPy arrays and as DataFrame operators.

Kernels follow the published formulas of the usual 8-bit image operations; agreement to the last bit
with a particular image library is not claimed. Images are BGR, as Spark's image source gives them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hudlake.schema import call_plan, id_type, region_spec

# Bounds of hue (0-179), saturation and value, and the parameters of the contrast chain.
WHITE_BOUNDS = ((0, 0, 190), (179, 60, 255))
CYAN_BOUNDS = ((80, 50, 120), (105, 255, 255))
CLIP, TILES = 3.0, 8
LOCAL_BLOCK, LOCAL_OFFSET = 31, 9
# Weights of blue, green and red, times 2 ** 15.
GRAY_15 = (3735, 19235, 9798)


def bounds(width: Column, height: Column, frac: dict[str, Column]) -> dict[str, Column]:
    """Pixel bounds of a fractional region: products are cut to whole numbers, then held inside the image."""
    inside = lambda size, f: F.greatest(F.lit(0), F.least(size, (size * f).cast("int")))
    return {"x1": inside(width, frac["x1"]), "y1": inside(height, frac["y1"]), "x2": inside(width, frac["x2"]), "y2": inside(height, frac["y2"])}


def crop_bounds(images: DataFrame) -> DataFrame:
    """(image_id, roi, x1, y1, x2, y2) for images with width and height; the six regions are a constant side."""
    spec = F.broadcast(region_spec(images.sparkSession))
    b = bounds(F.col("width"), F.col("height"), {k: F.col(f"f.{k}") for k in ("x1", "y1", "x2", "y2")})
    return images.select("image_id", "width", "height").crossJoin(spec.select("roi", F.struct("x1", "y1", "x2", "y2").alias("f"))).select(
        "image_id", "roi", *[v.alias(k) for k, v in b.items()]
    )


def crop(image: np.ndarray, region: tuple[float, ...]) -> np.ndarray:
    h, w = image.shape[:2]
    x1, x2 = (min(w, max(0, int(w * f))) for f in (region[0], region[2]))
    y1, y2 = (min(h, max(0, int(h * f))) for f in (region[1], region[3]))
    return image[y1:y2, x1:x2].copy()


def hsv(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., i].astype("f8") for i in range(3))
    v, low = image.max(-1).astype("f8"), image.min(-1).astype("f8")
    span = v - low
    safe = np.where(span > 0, span, 1)
    degrees = np.select([span == 0, v == r, v == g], [0, 60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    s = np.where(v > 0, 255 * span / np.where(v > 0, v, 1), 0)
    return np.stack([np.rint((degrees % 360) / 2) % 180, np.rint(s), v], axis=-1)


def neighbours(a: np.ndarray, mode: str, **fill) -> np.ndarray:
    """The nine shifted copies of ``a`` around each pixel."""
    p = np.pad(a, 1, mode=mode, **fill)
    h, w = a.shape
    return np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def colour_mask(image: np.ndarray, within: tuple) -> np.ndarray:
    """Pixels inside the bounds, cleaned by a 3x3 median and closed by a 3x3 square."""
    if not image.size:
        return np.zeros(image.shape[:2], "u1")
    x = hsv(image)
    hit = np.where(((x >= within[0]) & (x <= within[1])).all(-1), 255, 0).astype("u1")
    calm = np.median(neighbours(hit, "edge"), axis=0).astype("u1")
    grown = neighbours(calm, "constant", constant_values=0).max(0)
    return neighbours(grown, "constant", constant_values=255).min(0)


def white_mask(image: np.ndarray) -> np.ndarray:
    return colour_mask(image, WHITE_BOUNDS)


def cyan_mask(image: np.ndarray) -> np.ndarray:
    return colour_mask(image, CYAN_BOUNDS)


def gray(image: np.ndarray) -> np.ndarray:
    """0.114 B + 0.587 G + 0.299 R in fixed point of 15 bits, rounded, as 8-bit images are usually turned grey."""
    return (image.astype("i4") @ np.array(GRAY_15) + (1 << 14) >> 15).astype("u1")


def equalized(a: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: tile maps, blended between the four nearest tiles."""
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) < 2 else "reflect" if h > th * tiles - h and w > tw * tiles - w else "edge")
    area = th * tw
    limit = max(int(clip * area / 256), 1)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            count = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(count - limit, 0).sum())
            count = np.minimum(count, limit) + over // 256
            left = over % 256
            if left:
                count[np.arange(left) * max(256 // left, 1)] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(count) * 255 / area), 0, 255)
    y, x = (np.arange(h) + 0.0) / th - 0.5, (np.arange(w) + 0.0) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: maps[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :], a]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype("u1")


def smoothed(a: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    """Separable filter over both axes."""
    k = len(kernel) // 2
    out = a.astype("f8")
    for axis in (0, 1):
        widths = [(k, k) if i == axis else (0, 0) for i in (0, 1)]
        p = np.pad(out, widths, mode=mode if out.shape[axis] > k or mode == "edge" else "edge")
        out = sum(w * np.take(p, range(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return out


def contrast(image: np.ndarray) -> np.ndarray:
    return np.rint(smoothed(equalized(gray(image)), np.array([0.25, 0.5, 0.25]), "reflect")).astype("u1")


def binarized(a: np.ndarray, block: int = LOCAL_BLOCK, offset: int = LOCAL_OFFSET) -> np.ndarray:
    """255 where a pixel exceeds its Gaussian neighbourhood mean less the offset."""
    sigma = 0.3 * ((block - 1) / 2 - 1) + 0.8
    kernel = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    return np.where(a > np.rint(smoothed(a, kernel / kernel.sum(), "edge")) - offset, 255, 0).astype("u1")


def three_channels(a: np.ndarray) -> np.ndarray:
    """BGR out of one channel (three equal ones), one with alpha, three, or three with alpha, which is left out."""
    a = a[..., None] if a.ndim == 2 else a
    return np.repeat(a[..., :1], 3, axis=2) if a.shape[2] < 3 else a[..., :3]


def usable() -> Column:
    """Whether an image row holds the pixels that its size states."""
    sized = F.col("width").cast("long") * F.col("height") * F.col("channels")
    return F.coalesce((F.col("height") > 0) & (F.col("width") > 0) & F.col("channels").between(1, 4) & (F.length("data") == sized), F.lit(False))


VARIANTS = {"raw": lambda x: x, "white": white_mask, "cyan": cyan_mask, "binary": lambda x: binarized(contrast(x)) if x.size else np.zeros(x.shape[:2], "u1")}
CROPS = "call_no int, language_code string, height int, width int, channels int, data binary"


def crops(images: DataFrame, profile: str = "current", languages: list[str] | None = None) -> DataFrame:
    """Pixels of every recognition call of every ``usable`` image (image_id, height, width, channels, data)."""
    from hudlake.schema import REGIONS

    plan = call_plan(images.sparkSession, profile)
    calls = [tuple(r) for r in plan.select("call_no", "roi", "variant", "language_code").collect() if languages is None or r.language_code in languages]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                image = three_channels(np.frombuffer(row.data, "u1").reshape(row.height, row.width, row.channels))
                made, out = {}, []
                for call_no, roi, variant, language in calls:
                    if (roi, variant) not in made:
                        made[roi, variant] = VARIANTS[variant](crop(image, REGIONS[roi]))
                    x = made[roi, variant]
                    out.append((row.image_id, call_no, language, x.shape[0], x.shape[1], x.shape[2] if x.ndim == 3 else 1, x.tobytes()))
                yield pd.DataFrame(out, columns=["image_id", "call_no", "language_code", "height", "width", "channels", "data"])

    return images.where(usable()).select("image_id", "height", "width", "channels", "data").mapInPandas(run, f"image_id {id_type(images)}, {CROPS}")
