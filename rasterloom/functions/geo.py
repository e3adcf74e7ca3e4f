"""Distance, bounding-box and scene-request expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.functions.text import strip


def pixel_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance; a missing coordinate counts as 0 (M1)."""
    zero = F.lit(0)
    dx = (F.coalesce(x2, zero) - F.coalesce(x1, zero)).cast("double")
    dy = (F.coalesce(y2, zero) - F.coalesce(y1, zero)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def in_unit(distance: Column, unit: Column, pixels_per_unit: Column) -> Column:
    """Distance in the chosen unit, from the value as shown with three decimals (M3)."""
    shown = F.round(distance, 3)
    lo, hi = fixed.PIXELS_PER_UNIT_LIMITS
    scale = F.when(pixels_per_unit.between(lo, hi), pixels_per_unit).otherwise(
        F.raise_error(F.concat(F.lit("pixels per unit out of bounds: "), pixels_per_unit.cast("string")))
    )
    unknown = F.raise_error(F.concat(F.lit("unknown unit: "), unit))
    return (
        F.when(unit == "pixels", shown)
        .when(unit.isin(fixed.UNITS), shown / scale.cast("double"))
        .otherwise(unknown.cast("double"))
    )


def bounding_box(lat: Column, lon: Column, width_m: float | None = None, height_m: float | None = None) -> Column:
    """struct<west, south, east, north> of a rectangle around a point (M4)."""
    width = fixed.SECTOR_METRES if width_m is None else width_m
    height = fixed.SECTOR_METRES if height_m is None else height_m
    half_lat = F.lit(height / 2) / F.lit(float(fixed.METRES_PER_DEGREE))
    half_lon = F.lit(width / 2) / (F.lit(float(fixed.METRES_PER_DEGREE)) * F.cos(F.radians(lat)))
    return F.struct(
        (lon - half_lon).alias("west"),
        (lat - half_lat).alias("south"),
        (lon + half_lon).alias("east"),
        (lat + half_lat).alias("north"),
    )


def native_size(box: Column, resolution_m: float = fixed.SCENE_RESOLUTION_METRES) -> Column:
    """struct<width, height> in pixels at the given resolution, halves to even (M5)."""
    middle = (box["south"] + box["north"]) / 2
    per_lon = F.lit(float(fixed.METRES_PER_DEGREE)) * F.cos(F.radians(middle))
    width = (box["east"] - box["west"]) * per_lon / F.lit(float(resolution_m))
    height = (box["north"] - box["south"]) * F.lit(float(fixed.METRES_PER_DEGREE)) / F.lit(float(resolution_m))
    return F.struct(F.bround(width).cast("int").alias("width"), F.bround(height).cast("int").alias("height"))


def boxes_overlap(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def cache_key(name: Column, rule: str = "slash") -> Column:
    """File name under which a scene is cached.

    Rule ``slash`` replaces blanks and slashes (M6), rule ``dash`` blanks and dashes (M7). Neither
    resolves aliases, so two names of one place are two entries.
    """
    replaced = {"slash": " /", "dash": " -"}[rule]
    return F.concat(F.translate(F.upper(strip(name)), replaced, "__"), F.lit(".png"))


def scene_request(
    box: Column,
    width: Column,
    height: Column,
    date_from: str = fixed.SCENE_FROM,
    date_to: str = fixed.SCENE_TO,
    script: str = fixed.COMPOSITE_SCRIPT,
) -> Column:
    """Nested request structure for one scene (M8); ``to_json`` turns it into the payload.

    ``script`` computes the picture on the service's side, pixel by pixel.
    """
    time_range = F.struct(F.lit(date_from).alias("from"), F.lit(date_to).alias("to"))
    data_filter = F.struct(time_range.alias("timeRange"), F.lit(fixed.SCENE_ORDER).alias("mosaickingOrder"))
    source = F.struct(F.lit(fixed.SCENE_COLLECTION).alias("type"), data_filter.alias("dataFilter"))
    bounds = F.struct(F.array(box["west"], box["south"], box["east"], box["north"]).alias("bbox"))
    response = F.struct(
        F.lit("default").alias("identifier"), F.struct(F.lit(fixed.SCENE_FORMAT).alias("type")).alias("format")
    )
    return F.struct(
        F.struct(bounds.alias("bounds"), F.array(source).alias("data")).alias("input"),
        F.struct(width.alias("width"), height.alias("height"), F.array(response).alias("responses")).alias("output"),
        F.lit(script).alias("evalscript"),
    )
