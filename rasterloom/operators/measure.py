"""Clicked points: bounds, pairing, distances and inspection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rasterloom.functions import geo, pixel
from rasterloom.operators.lookup import Settled, fits_broadcast, lookup_join
from rasterloom.schema import is_colour
from rasterloom.session import settle


def in_bounds(points: DataFrame, images: DataFrame | Settled) -> DataFrame:
    """Points that lie on their image; ``images`` holds (image_id, height, width) (F2). It is settled now if it is not."""
    shaped = lookup_join(points, images.select("image_id", "height", "width"), ["image_id"], "inner")
    inside = F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    return shaped.where(inside).drop("height", "width")


STRETCHES = 4096


def _stretch_cuts(clicks: DataFrame, clicks_each: int) -> np.ndarray:
    """Event ids that cut all clicks into stretches of about equal numbers, at most ``STRETCHES`` of them."""
    n = clicks.count()
    stretches = min(STRETCHES, -(-n // clicks_each))
    if stretches <= 1:
        return np.zeros(0, np.int64)
    shares = [i / stretches for i in range(1, stretches)]
    return np.unique(np.array(clicks.agg(F.percentile_approx("event_id", shares, 4 * stretches)).first()[0], np.int64))


def pair_clicks(clicks: DataFrame, clicks_each: int = 100_000) -> DataFrame:
    """Two clicks in a row on one image make a measurement.

    ``clicks``: (user_id, event_id, image_id, x, y, ...), already limited to points on an image; event_id
    orders them. A click on another image drops the pending point and becomes the first one. Clicks without a
    user or an event id belong to no run and are left out.

    A user may hold any share of the clicks, so users are cut into stretches of event_id that hold about
    ``clicks_each`` clicks of all users, whatever the ids look like; their bounds are looked up now, in two small jobs.
    Runs are found inside a stretch, one summary row per stretch carries the open run and the last click
    to the next one. Extra columns are taken from the second click.
    """
    keys = ["user_id", "bucket"]
    local = Window.partitionBy(*keys).orderBy("event_id")
    point = F.struct("image_id", "x", "y")
    known = clicks.where("user_id IS NOT NULL AND event_id IS NOT NULL")
    cuts = _stretch_cuts(known, clicks_each)

    @F.pandas_udf("int")
    def stretch(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right").astype(np.int32))

    rows = known.withColumn("bucket", stretch("event_id") if len(cuts) else F.lit(0))
    rows = rows.withColumn("before", F.lag(point).over(local))
    rows = rows.withColumn("turn", (F.col("before.image_id") != F.col("image_id")).cast("int"))
    rows = rows.withColumn("run", F.sum(F.coalesce("turn", F.lit(0))).over(local))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("event_id")))

    ends = rows.groupBy(*keys).agg(
        F.min_by("image_id", "event_id").alias("first_image"),
        F.max_by(F.struct("image_id", "x", "y"), "event_id").alias("last"),
        F.max_by("place", "event_id").alias("open_places"),
        F.max("run").alias("runs"),
    )
    along = Window.partitionBy("user_id").orderBy("bucket")
    ends = ends.withColumn("carried", F.lag("last").over(along))
    ends = ends.withColumn("continues", F.coalesce(F.col("carried.image_id") == F.col("first_image"), F.lit(False)))
    # a stretch that is one run continuing the previous one adds to its length; any other starts anew
    fresh = F.when(F.col("continues") & (F.col("runs") == 0), 0).otherwise(1)
    ends = ends.withColumn("chain", F.sum(fresh).over(along))
    chained = Window.partitionBy("user_id", "chain").orderBy("bucket")
    ends = ends.withColumn("open_total", F.sum("open_places").over(chained))
    ends = ends.withColumn("carried_places", F.when(F.col("continues"), F.lag("open_total").over(along)).otherwise(0))

    joined = rows.join(ends.select(*keys, "carried", "carried_places"), keys)
    place = F.col("place") + F.when(F.col("run") == 0, F.col("carried_places")).otherwise(0)
    first = F.coalesce("before", "carried")
    return (
        joined.withColumn("first", first)
        .where(place % 2 == 0)
        .withColumns({"x1": F.col("first.x"), "y1": F.col("first.y")})
        .withColumnsRenamed({"x": "x2", "y": "y2"})
        .drop("bucket", "before", "turn", "run", "place", "carried", "carried_places", "first")
    )


def measured(pairs: DataFrame) -> DataFrame:
    """Add the pixel distance of (x1, y1) and (x2, y2) (M1)."""
    return pairs.withColumn("distance", geo.pixel_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def in_units(measures: DataFrame) -> DataFrame:
    """Add ``in_unit``, the distance in the row's ``unit`` at its ``ppu`` pixels per unit (M3)."""
    return measures.withColumn("in_unit", geo.in_unit(F.col("distance"), F.col("unit"), F.col("ppu")))


def inspect(points: DataFrame, pixels: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """Points with the text of the pixel they hit, dashes off the image.

    Few different points are broadcast to a scan of the pixels. Many are matched by shuffle, each
    different point once, before the texts go back to the points.
    """
    keys = ["image_id", "y", "x"]
    asked = settle(points.select(*keys).distinct())
    small = fits_broadcast(asked, limit=broadcast_bytes)
    hits = pixels.join(F.broadcast(asked) if small else asked.hint("merge"), keys)
    if is_colour(pixels):
        alpha = F.col("a") if "a" in pixels.columns else None
        text = pixel.colour_text(F.col("x"), F.col("y"), F.col("b"), F.col("g"), F.col("r"), alpha)
    else:
        text = pixel.gray_text(F.col("x"), F.col("y"), F.col("v"))
    texts = hits.select(*keys, text.alias("text"))
    found = lookup_join(points, texts, keys, "left", broadcast_bytes=broadcast_bytes)
    return found.withColumn("text", F.coalesce("text", F.lit("x: -, y: -, value: -")))
