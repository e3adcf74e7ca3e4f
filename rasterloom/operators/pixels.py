"""Pointwise operators on gray and colour pixel tables (P1..P13).

Colour tables are changed band by band; alpha and every other column pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.functions import pixel
from rasterloom.schema import is_colour, value_columns


def _per_value(pixels: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return pixels.withColumns({c: change(F.col(c)) for c in value_columns(pixels)})


def to_grayscale(pixels: DataFrame) -> DataFrame:
    """Gray pixels; alpha is dropped and gray input comes back unchanged."""
    if not is_colour(pixels):
        return pixels
    others = [c for c in pixels.columns if c not in ("b", "g", "r", "a")]
    return pixels.select(*others, pixel.luminance(F.col("b"), F.col("g"), F.col("r")).alias("v"))


def negative(pixels: DataFrame) -> DataFrame:
    return _per_value(pixels, pixel.negative)


def brightness(pixels: DataFrame, value: int = fixed.BRIGHTNESS) -> DataFrame:
    lo, hi = fixed.BRIGHTNESS_LIMITS
    if is_colour(pixels) and not lo <= value <= hi:
        raise ValueError(f"brightness must lie in {lo}..{hi}: {value}")
    return _per_value(pixels, lambda v: pixel.brightness(v, value))


def threshold(pixels: DataFrame, value: int = fixed.THRESHOLD) -> DataFrame:
    lo, hi = fixed.THRESHOLD_LIMITS
    if is_colour(pixels) and not lo <= value <= hi:
        raise ValueError(f"threshold must lie in {lo}..{hi}: {value}")
    return _per_value(pixels, lambda v: pixel.threshold(v, value))


def reorder_rgb(pixels: DataFrame) -> DataFrame:
    """Columns in display order R, G, B[, A]."""
    order = [c for c in ("r", "g", "b", "a") if c in pixels.columns]
    return pixels.select(*[c for c in pixels.columns if c not in order], *order)


def split_channels(pixels: DataFrame, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """One row per pixel and band (P12); ``luminance`` is a band too, alpha is not."""
    source = {
        "red": F.col("r"),
        "green": F.col("g"),
        "blue": F.col("b"),
        "luminance": pixel.luminance(F.col("b"), F.col("g"), F.col("r")),
    }
    entries = F.array(*[F.struct(F.lit(band).alias("band"), source[band].alias("v")) for band in bands])
    keys = [c for c in ("image_id", "y", "x") if c in pixels.columns]
    return pixels.select(*keys, F.inline(entries))


def true_colour(samples: DataFrame, scale: float = 255.0) -> DataFrame:
    """Composite of the reflectance columns b02, b03, b04 into b, g, r."""
    level = {"b": "b02", "g": "b03", "r": "b04"}
    keys = [c for c in samples.columns if c not in level.values()]
    return samples.select(*keys, *[pixel.composite_level(F.col(s), scale).alias(c) for c, s in level.items()])
