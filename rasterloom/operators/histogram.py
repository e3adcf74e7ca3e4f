"""Exact 256-level histograms and everything that follows from them (A1..A5, A13, N6).

The histogram is the only pixel-sized aggregation: it is combined map-side, so a task ships at most 256
rows per image and band, however large an image is. Gray operators also take levels that are counted
already (image_id, v, n), see :func:`counted_levels`: pointwise operations on these cost 256 rows an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.operators.pixels import split_channels
from rasterloom.schema import LEVELS, checked_level, is_colour, is_counted
from rasterloom.session import settle

SERIES = ["image_id", "band"]


def _series(table: DataFrame) -> list[str]:
    """Key columns of a table. Inside this module gray tables have no band: grouping by a constant would
    hide from the planner that rows already lie together by image."""
    return [c for c in SERIES if c in table.columns]


def _with_band(table: DataFrame) -> DataFrame:
    if "band" in table.columns:
        return table
    return table.select("image_id", F.lit("gray").alias("band"), *[c for c in table.columns if c != "image_id"])


def _level_counts(pixels: DataFrame, bands: tuple[str, ...] | None = None, bytes_only: bool = True) -> DataFrame:
    n = F.count(F.lit(1))
    if is_colour(pixels):
        values = split_channels(pixels, bands or ("red", "green", "blue"))
    elif is_counted(pixels):
        values, n = pixels.select("image_id", "v", "n"), F.sum("n")
    else:
        values = pixels.select("image_id", "v")
    counts = values.groupBy(*_series(values), "v").agg(n.alias("n"))
    return _checked(counts) if bytes_only else counts


def counted_levels(gray: DataFrame) -> DataFrame:
    """(image_id, v, n) of gray pixels, counted now and held as a checkpoint of at most 256 rows per image.

    Histograms, statistics, code books and k-means take it in place of the pixels, also after pointwise operations.
    """
    return settle(_level_counts(gray))


def _checked(counts: DataFrame) -> DataFrame:
    """The job fails on a level outside 0..255; looked at once per level, not per pixel."""
    return counts.withColumn("v", checked_level(F.col("v")))


def level_counts(pixels: DataFrame, bands: tuple[str, ...] | None = None, bytes_only: bool = True) -> DataFrame:
    """(image_id, band, v, n) for the levels that occur.

    Rows by level need no levels of a byte: without ``bytes_only`` levels outside 0..255 are counted like the others,
    and missing ones as a null level.
    """
    return _with_band(_level_counts(pixels, bands, bytes_only))


def image_counts(pixels: DataFrame) -> DataFrame:
    """(image_id, counts, total): the 256 level counts of gray pixels, one row per image."""
    return dense_counts(_level_counts(pixels), ["image_id"])


def byte_counts(pixels: DataFrame) -> DataFrame:
    """(image_id, v, n) over all channel bytes of an image together, alpha included (H1)."""
    if is_colour(pixels):
        channels = [c for c in ("b", "g", "r", "a") if c in pixels.columns]
        values = pixels.select("image_id", F.explode(F.array(*channels)).alias("v")).where("v IS NOT NULL")
    else:
        return _level_counts(pixels)
    return _checked(values.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n")))


_SHIFT = 50  # a count in the low bits, its level above them


def dense_counts(counts: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One row per key: ``counts`` ARRAY<BIGINT> of all 256 levels and their ``total``.

    The levels that occur and a zero for every level are sorted together as integers; of equal levels the
    last one, which has the count, is kept.
    """
    packed = F.collect_list(F.shiftleft(F.col("v").cast("long"), _SHIFT) + F.col("n"))
    zeros = F.lit([v << _SHIFT for v in range(LEVELS + 1)])
    rows = counts.groupBy(*keys).agg(packed.alias("packed"), F.sum("n").alias("total"))
    ordered = rows.withColumn("packed", F.sort_array(F.concat("packed", zeros)))

    def last_of_level(entry: Column, following: Column) -> Column:
        ends = F.shiftright(entry, _SHIFT) != F.shiftright(following, _SHIFT)
        return F.when(ends, entry.bitwiseAND(F.lit((1 << _SHIFT) - 1)))

    last = F.zip_with("packed", F.slice("packed", 2, 2 * LEVELS + 1), last_of_level)
    return ordered.select(*keys, F.array_compact(last).alias("counts"), "total")


def _exact_histogram(pixels: DataFrame, bands: tuple[str, ...] | None = None) -> DataFrame:
    counts = _level_counts(pixels, bands)
    series = _series(counts)
    # outer, because for an inner one the planner would compute the array twice to filter empty ones
    return dense_counts(counts, series).select(*series, F.posexplode_outer("counts").alias("v", "n"))


def exact_histogram(pixels: DataFrame, bands: tuple[str, ...] | None = None) -> DataFrame:
    """(image_id, band, v, n) with all 256 levels, zeros included (A2)."""
    return _with_band(_exact_histogram(pixels, bands))


def rebin(histogram: DataFrame, bins: int, density: bool = False, cumulative: bool = False) -> DataFrame:
    """(image_id, band, bin, lo, hi, mass) over ``bins`` equal bins of 0..256 (A3, A4).

    A level is a bucket of width 1, spread over the bins it overlaps. Plain bars are mass per width,
    density is mass per total and width; the cumulative modes are running sums of the mass or of the
    density values (not of density times width).
    """
    lo, hi = fixed.BIN_LIMITS
    if not lo <= bins <= hi:
        raise ValueError(f"bins must lie in {lo}..{hi}: {bins}")
    width = LEVELS / bins
    edge = lambda i: i.cast("double") * LEVELS / bins
    v = F.col("v")
    first = F.floor(v * bins / F.lit(LEVELS)).cast("int")
    last = (F.ceil((v + 1) * bins / F.lit(LEVELS)) - 1).cast("int")
    keys = _series(histogram)
    spread = histogram.select(*keys, "v", "n", F.explode(F.sequence(first, last)).alias("bin"))
    overlap = F.least((v + 1).cast("double"), edge(F.col("bin") + 1)) - F.greatest(v.cast("double"), edge(F.col("bin")))
    mass = spread.groupBy(*keys, "bin").agg(F.sum(F.col("n") * overlap).alias("mass"))

    series = Window.partitionBy(*keys)
    if density:
        mass = mass.withColumn("total", F.sum("mass").over(series)).withColumn(
            "mass", F.when(F.col("total") > 0, F.col("mass") / (F.col("total") * width)).otherwise(F.col("mass"))
        )
    elif not cumulative:
        mass = mass.withColumn("mass", F.col("mass") / width)
    if cumulative:
        running = series.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        mass = mass.withColumn("mass", F.sum("mass").over(running))
    return mass.select(*keys, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), "mass")


def smooth(binned: DataFrame, radius: int) -> DataFrame:
    """Moving average over 2 * radius + 1 bins; the outermost bins are repeated beyond the ends."""
    lo, hi = fixed.SMOOTHING_LIMITS
    if radius > hi:
        raise ValueError(f"smoothing radius must lie in {lo}..{hi}: {radius}")
    if radius <= 0:
        return binned
    ordered = Window.partitionBy(*_series(binned)).orderBy("bin")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = ordered.rowsBetween(-radius, radius)
    before = F.greatest(F.lit(0), radius - F.col("bin"))
    after = F.greatest(F.lit(0), F.col("bin") + radius - F.max("bin").over(whole))
    total = F.sum("mass").over(near) + before * F.first("mass").over(whole) + after * F.last("mass").over(whole)
    return binned.withColumn("mass", total / (2 * radius + 1))


PLOT_BANDS = {
    "RGB Overlay": ("red", "green", "blue"),
    "Red": ("red",),
    "Green": ("green",),
    "Blue": ("blue",),
    "Luminance": ("luminance",),
    "Smoothed": ("luminance",),
}


def plot_table(
    pixels: DataFrame,
    mode: str = "RGB Overlay",
    bins: int = LEVELS,
    density: bool = False,
    cumulative: bool = False,
    smoothing: int = 0,
) -> DataFrame:
    """The series behind a histogram plot (A5). Mode Smoothed is the luminance; only ``smoothing`` smooths."""
    bands = PLOT_BANDS[mode] if is_colour(pixels) else None
    return _with_band(smooth(rebin(_exact_histogram(pixels, bands), bins, density, cumulative), smoothing))


def statistics(pixels: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and population standard deviation of gray pixels per image (A1).

    Those of counted levels come from exact integer sums.
    """
    if is_counted(pixels):
        total, squares = (F.sum(F.col("n") * part).cast("decimal(38,0)") for part in (F.col("v"), F.col("v") * F.col("v")))
        sums = pixels.groupBy("image_id").agg(
            F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.sum("n").alias("n"), total.alias("s1"), squares.alias("s2")
        )
        # n s2 - s1^2 is exact: neither product passes 38 digits below 10^15 pixels
        exact = F.expr("CAST(CAST(n AS DECIMAL(18,0)) * CAST(s2 AS DECIMAL(20,0)) - CAST(s1 AS DECIMAL(18,0)) * CAST(s1 AS DECIMAL(18,0)) AS DOUBLE)")
        return sums.select(
            "image_id", "min_value", "max_value", (F.col("s1").cast("double") / F.col("n")).alias("mean"), (F.sqrt(exact) / F.col("n")).alias("std_dev")
        )
    return pixels.groupBy("image_id").agg(
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std_dev"),
    )


def distinct_values(counts: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Number of different levels, and the sorted list of them, from a histogram."""
    return counts.where("n > 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_values"), F.sort_array(F.collect_list("v")).alias("levels")
    )
