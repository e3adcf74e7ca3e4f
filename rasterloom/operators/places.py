"""Place names, bounding boxes and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.functions import geo
from rasterloom.functions.text import strip
from rasterloom.operators.lookup import Settled, fits_broadcast, lookup_join, salted_join
from rasterloom.session import settle


def built_in_locations(spark: SparkSession) -> DataFrame:
    rows = [(code, lat, lon) for code, (lat, lon) in fixed.SECTORS.items()]
    return spark.createDataFrame(rows, "code STRING, lat DOUBLE, lon DOUBLE")


def built_in_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.ALIASES.items()), "alias STRING, code STRING")


def resolve(
    names: DataFrame,
    locations: DataFrame,
    aliases: DataFrame,
    strict: bool = False,
    broadcast_bytes: int | None = None,
    literal: bool = False,
) -> DataFrame:
    """Add code, lat, lon and ``resolved`` to a ``name`` column.

    The trimmed name is looked up as a code in upper case, then as an alias in lower case. Unknown names
    stay with nulls, or fail the job if ``strict``. An alias to a missing code resolves to nothing.

    Both tables are settled now, to measure them, unless they are ``literal``, such as the built-in ones: then their
    size is known to be small.
    """
    place = F.struct("code", "lat", "lon")
    by_code = locations.select(F.col("code").alias("as_code"), place.alias("by_code"))
    by_alias = aliases.join(locations, "code").select(F.col("alias").alias("as_alias"), place.alias("by_alias"))
    if literal:
        by_code, by_alias = Settled(by_code, 0), Settled(by_alias, 0)
    clean = strip(F.coalesce("name", F.lit("")))
    keyed = names.withColumns({"as_code": F.upper(clean), "as_alias": F.lower(clean)})
    found = lookup_join(keyed, by_code, ["as_code"], "left", broadcast_bytes=broadcast_bytes)
    found = lookup_join(found, by_alias, ["as_alias"], "left", broadcast_bytes=broadcast_bytes)
    found = found.withColumn("place", F.coalesce("by_code", "by_alias"))
    if strict:
        unknown = F.raise_error(F.concat(F.lit("Unknown location: "), F.coalesce("name", F.lit(""))))
        found = found.withColumn("place", F.when(F.col("place").isNull(), unknown).otherwise(F.col("place")))
    return found.select(*names.columns, "place.*", F.col("place").isNotNull().alias("resolved"))


def with_box(places: DataFrame, width_m: float | None = None, height_m: float | None = None) -> DataFrame:
    """Add the bounding box struct of lat/lon (M4)."""
    return places.withColumn("box", geo.bounding_box(F.col("lat"), F.col("lon"), width_m, height_m))


def scene_manifest(
    places: DataFrame,
    key_rule: str = "slash",
    date_from: str = fixed.SCENE_FROM,
    date_to: str = fixed.SCENE_TO,
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """One request per resolved name: box, size, cache key and JSON payload (M5, M6, M7, M8)."""
    boxed = with_box(places.where("resolved")).withColumn("cache_key", geo.cache_key(F.col("name"), key_rule))
    pixels = geo.native_size(F.col("box"))
    if size is not None:
        pixels = F.struct(F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height"))
    sized = boxed.withColumn("size", pixels)
    request = geo.scene_request(F.col("box"), F.col("size.width"), F.col("size.height"), date_from, date_to)
    return sized.withColumn("payload", F.to_json(request))


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Scenes still to fetch, each once, with the number of requests for it.

    Requests are counted per key before the join, so a popular scene is one row in it.
    """
    return _wanted(requests).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Scenes answered from the cache, with the number of requests for each."""
    return _wanted(requests).join(cache.select("cache_key").distinct(), "cache_key", "left_semi")


def _wanted(requests: DataFrame) -> DataFrame:
    return requests.groupBy("cache_key").agg(F.count(F.lit(1)).alias("requests"))


def scene_filter(
    scenes: DataFrame, date_from: str, date_to: str, area: Column | None = None, collection: str | None = None
) -> DataFrame:
    """Scenes of a time range (start included, end not), a collection and an area.

    The conditions are plain comparisons, so they reach the scan and prune date partitions.
    """
    kept = scenes.where((F.col("ts") >= F.lit(date_from)) & (F.col("ts") < F.lit(date_to)))
    if collection is not None:
        kept = kept.where(F.col("collection") == collection)
    if area is not None:
        kept = kept.where(geo.boxes_overlap(F.col("box"), area))
    return kept


def least_cloudy(scenes: DataFrame) -> DataFrame:
    """Per tile the scene with the least cloud; ties to the newest, then the lowest id."""
    rank = F.struct((-F.col("cloud_pct")).alias("clear"), "ts", (-F.col("scene_id")).alias("low_id"))
    best = scenes.groupBy("tile").agg(F.max(rank).alias("best"))
    return best.select(
        "tile",
        (-F.col("best.low_id")).alias("scene_id"),
        F.col("best.ts").alias("ts"),
        (-F.col("best.clear")).alias("cloud_pct"),
    )


def points_in_boxes(
    points: DataFrame,
    boxes: DataFrame,
    cell: float = 0.05,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Every (point, box) pair where the point lies in the box, edges included.

    ``points``: lat, lon and any other columns; ``boxes``: code and box. There is a grid for every doubling of the
    ``cell``; a box is listed in the first grid whose cells are not smaller than it, so under four cells at most,
    and a point once in every grid that has a box. Both sides meet on the cell and only then compare coordinates.
    The listing is settled now, to measure it and to see which grids there are.
    """
    spread = F.greatest(F.col("box.east") - F.col("box.west"), F.col("box.north") - F.col("box.south"))

    def grid(v: Column) -> Column:
        return F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), F.col("grid"))))

    sized = boxes.select("code", "box").where(spread >= 0)
    gridded = sized.withColumn("grid", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(spread, F.lit(cell)) / cell))).cast("int"))
    columns = F.explode(F.sequence(grid(F.col("box.west")), grid(F.col("box.east"))))
    rows = F.explode(F.sequence(grid(F.col("box.south")), grid(F.col("box.north"))))
    listed = settle(gridded.withColumn("cx", columns).withColumn("cy", rows))
    grids = sorted(r["grid"] for r in listed.select("grid").distinct().collect())  # at most a few dozen doublings
    keys = ["grid", "cx", "cy"]
    placed = points.withColumn("grid", F.explode(F.array(*map(F.lit, grids)).cast("array<int>")))
    placed = placed.withColumns({"cx": grid(F.col("lon")), "cy": grid(F.col("lat"))})
    if fits_broadcast(listed, limit=broadcast_bytes):
        near = placed.join(F.broadcast(listed), keys)
    else:
        near = salted_join(placed, listed, keys, ["lat", "lon", *_identity(points)])
    inside = F.col("lon").between(F.col("box.west"), F.col("box.east")) & F.col("lat").between(
        F.col("box.south"), F.col("box.north")
    )
    return near.where(inside).drop(*keys)


def _identity(points: DataFrame) -> list[str]:
    return [c for c in points.columns if c not in ("lat", "lon")]
