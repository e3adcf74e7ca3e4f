"""Table layouts and the checks made when pixels enter the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PIXELS = "image_id BIGINT, y INT, x INT, v INT"
PIXELS_BGR = "image_id BIGINT, y INT, x INT, b INT, g INT, r INT, a INT"
HIST = "image_id BIGINT, band STRING, v INT, n BIGINT"

LEVELS = 256
POSITION = ["image_id", "y", "x"]


def is_colour(pixels: DataFrame) -> bool:
    """Colour tables carry b, g, r (and perhaps a); gray tables carry v."""
    return {"b", "g", "r"} <= set(pixels.columns)


def is_counted(pixels: DataFrame) -> bool:
    """Whether a gray table holds counted levels (image_id, v, n) in place of pixels."""
    return {"v", "n"} <= set(pixels.columns) and "x" not in pixels.columns


def value_columns(pixels: DataFrame) -> list[str]:
    return ["b", "g", "r"] if is_colour(pixels) else ["v"]


def checked_level(value: Column) -> Column:
    """The value itself; the job fails on one that does not fit a byte."""
    message = F.concat(F.lit("pixel value outside 0..255: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(value.between(0, 255), value.cast("int")).otherwise(F.raise_error(message))


def checked_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: checked_level(F.col(c)) for c in value_columns(pixels)})


def image_shapes(pixels: DataFrame) -> DataFrame:
    """Height and width per image (A12); one row per image, map-side combined."""
    return pixels.groupBy("image_id").agg(
        (F.max("y") + 1).cast("int").alias("height"),
        (F.max("x") + 1).cast("int").alias("width"),
        F.count(F.lit(1)).alias("n_pixels"),
    )


def sparse_images(pixels: DataFrame) -> DataFrame:
    """Images whose pixel count is not height x width: missing, ragged or repeated cells."""
    shape = image_shapes(pixels)
    return shape.where(F.col("n_pixels") != F.col("height").cast("long") * F.col("width"))
