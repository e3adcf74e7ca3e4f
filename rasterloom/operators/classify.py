"""Classification by ranges, legends and land-cover maps (A7, A11, C5..C11, P14..P16, J4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rasterloom.functions.colour import default_colours, default_names, default_ranges, pick, ranges_literal
from rasterloom.operators.cluster import count_between, level_lookup, range_lookup, with_cluster
from rasterloom.operators.lookup import Settled, lookup_join, settled
from rasterloom.schema import LEVELS
from rasterloom.session import settle

Ranges = list[tuple[int, int]] | DataFrame


def range_counts(counted: DataFrame, ranges: Ranges) -> DataFrame:
    """Pixels and share per range (A7): (image_id, cluster, lo, hi, n, share, percent, invalid).

    ``counted`` comes from :func:`histogram.image_counts` or a k-means model. A range with lo > hi counts nothing and is flagged.
    ``share`` is the exact percentage; ``percent`` is that binary number rounded to one decimal, as it is shown.
    """
    if isinstance(ranges, DataFrame):
        rows = counted.join(ranges.select("image_id", "cluster", "lo", "hi"), "image_id")
    else:
        rows = counted.select("*", F.inline_outer(ranges_literal(ranges)))
    n = F.when(F.col("lo") <= F.col("hi"), count_between(F.col("counts"), F.col("lo"), F.col("hi"))).otherwise(
        F.lit(0).cast("long")
    )
    return _shares(rows.withColumn("n", n))


def model_counts(model: DataFrame) -> DataFrame:
    """The same for the ranges a k-means model found, whose pixels it has counted."""
    rows = model.select("image_id", "total", F.explode(F.zip_with("ranges", "members", lambda r, n: F.struct(r.alias("r"), n.alias("n")))).alias("x"))
    return _shares(rows.select("image_id", "total", "x.r.*", "x.n"))


@F.pandas_udf(T.DoubleType())
def _one_decimal(share: pd.Series) -> pd.Series:
    """Rounds the binary number itself; there are a few rows per image."""
    return share.map(lambda x: round(x, 1))


def _shares(rows: DataFrame) -> DataFrame:
    share = F.coalesce(F.try_divide(F.col("n"), F.col("total")) * 100, F.lit(0.0))
    return (
        rows.withColumn("share", share)
        .select(
            "image_id",
            "cluster",
            "lo",
            "hi",
            "n",
            "share",
            _one_decimal("share").alias("percent"),
            (F.col("lo") > F.col("hi")).alias("invalid"),
        )
    )


def edit_bounds(ranges: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply one edited bound per image and repair its direct neighbour.

    ``edits``: (image_id, cluster, side, value) with side ``hi`` or ``lo``. A new upper bound moves the
    lower bound of the next cluster, a new lower bound the upper bound of the previous one.
    """
    edited = ranges.join(
        edits.select("image_id", "cluster", "side", "value"), ["image_id", "cluster"], "left"
    )
    by_cluster = Window.partitionBy("image_id").orderBy("cluster")
    new_hi = F.when(F.col("side") == "hi", F.col("value"))
    new_lo = F.when(F.col("side") == "lo", F.col("value"))
    pushed_lo = F.lag(new_hi).over(by_cluster)
    pulled_hi = F.lead(new_lo).over(by_cluster)
    lo = F.coalesce(new_lo, F.when(pushed_lo.isNotNull(), F.least(F.lit(255), pushed_lo + 1)), F.col("lo"))
    hi = F.coalesce(new_hi, F.when(pulled_hi.isNotNull(), F.greatest(F.lit(0), pulled_hi - 1)), F.col("hi"))
    return edited.select("image_id", "cluster", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def named(clusters: DataFrame, k: int, names: list[str] | None = None, colours: list | None = None) -> DataFrame:
    """Add ``name`` and the colour columns r, g, b of each cluster (J4); the defaults are C5."""
    names = names or default_names(k)
    return with_colour(clusters.withColumn("name", pick(names, F.col("cluster"), "")), k, colours)


def with_colour(clusters: DataFrame, k: int, colours: list | None = None) -> DataFrame:
    """Add display columns b, g, r for the cluster column; no cluster is black."""
    palette = colours or default_colours(k)
    return clusters.withColumns(
        {band: pick([rgb[i] for rgb in palette], F.col("cluster"), 0) for i, band in ((2, "b"), (1, "g"), (0, "r"))}
    )


def legend(
    counted: DataFrame,
    k: int,
    ranges: Ranges | None = None,
    names: list[str] | None = None,
    colours: list | None = None,
) -> DataFrame:
    """(image_id, cluster, name, n, share, percent, text, r, g, b), clusters of one name kept apart.

    ``text`` is the line of a legend, ``name-percent%`` with one decimal. Without ``ranges`` the default classification
    ranges are used, whatever k-means found: that is what the legend of a freshly clustered image shows. For the
    ranges that k-means found see :func:`model_legend`. The rows are in no order.
    """
    return _legend(range_counts(counted, default_ranges(k) if ranges is None else ranges), k, names, colours)


def model_legend(model: DataFrame, k: int, names: list[str] | None = None, colours: list | None = None) -> DataFrame:
    """The legend by the ranges of a k-means model, which agrees with its labels; needs nothing but the model."""
    return _legend(model_counts(model), k, names, colours)


def _legend(rows: DataFrame, k: int, names: list[str] | None, colours: list | None) -> DataFrame:
    text = F.concat("name", F.lit("-"), F.col("percent").cast("decimal(5,1)").cast("string"), F.lit("%"))
    columns = ["image_id", "cluster", "name", "n", "share", "percent", "text", "r", "g", "b"]
    return named(rows, k, names, colours).withColumn("text", text).select(*columns)


def land_cover_map(pixels: DataFrame, model: DataFrame | Settled, k: int, colours: list | None = None) -> DataFrame:
    """(image_id, y, x, cluster, r, g, b): k-means labels painted in map colours."""
    painted = with_colour(with_cluster(pixels, model), k, colours)
    return painted.select("image_id", "y", "x", "cluster", "r", "g", "b")


def land_cover(
    pixels: DataFrame,
    model: DataFrame,
    k: int,
    range_source: str = "preset",
    names: list[str] | None = None,
    colours: list | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The land-cover map and its legend (C11).

    ``range_source`` chooses the ranges the legend counts: ``preset`` for the default classification
    ranges, ``kmeans`` for the ranges the labels of the map come from. The model is settled now, once for both.
    """
    if range_source not in ("preset", "kmeans"):
        raise KeyError(range_source)
    known = settle(model)
    if range_source == "kmeans":
        rows = model_legend(known, k, names, colours)
    else:
        rows = legend(known.select("image_id", "counts", "total"), k, None, names, colours)
    return land_cover_map(pixels, settled(level_lookup(known)), k, colours), rows


def display_image(pixels: DataFrame, model: DataFrame, k: int, colours: list | None = None) -> DataFrame:
    """(image_id, y, x, b, g, r): the same labels in image channel order."""
    return land_cover_map(pixels, model, k, colours).select("image_id", "y", "x", "b", "g", "r")


def _shared_lookup(ranges: list[tuple[int, int]]) -> Column:
    covering = [[i for i, (lo, hi) in enumerate(ranges) if lo <= v <= hi] for v in range(LEVELS)]
    return F.lit([max(hits) if hits else -1 for hits in covering])


def recolour(
    pixels: DataFrame,
    ranges: Ranges,
    k: int,
    colours: list | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Paint gray pixels by (edited) ranges without clustering again.

    On overlap the highest cluster wins; levels outside every range are black.
    """
    if isinstance(ranges, DataFrame):
        per_image = (
            ranges.groupBy("image_id")
            .agg(F.array_sort(F.collect_list(F.struct("cluster", "lo", "hi"))).alias("ranges"))
            .select("image_id", range_lookup(F.col("ranges")).alias("lookup"))
        )
        joined = lookup_join(pixels, per_image, ["image_id"], "left", broadcast_bytes=broadcast_bytes)
        clustered = joined.withColumn("cluster", F.get("lookup", F.col("v")).cast("int")).drop("lookup")
    else:
        hit = F.get(_shared_lookup(ranges), F.col("v"))
        clustered = pixels.withColumn("cluster", F.when(hit >= 0, hit))
    return with_colour(clustered, k, colours).select("image_id", "y", "x", "b", "g", "r")
