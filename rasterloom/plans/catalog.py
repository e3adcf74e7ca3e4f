"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom import schema
from rasterloom.functions.colour import default_ranges
from rasterloom.operators import chain, classify, cluster, histogram, huffman, measure, pixels as px, places, prompts, stencil
from rasterloom.operators.lookup import lookup_join, settled
from rasterloom.plans import fixtures as fx
from rasterloom.session import new_folder
from rasterloom.sources import containers, gazetteer, images, matrices, runs, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _on(fixture: Query, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(fixture(spark, sf))


GRAY, COLOUR = fx.gray_rasters, fx.colour_rasters

QUERIES |= {
    "px_negative": _on(GRAY, px.negative),
    "px_brighter": _on(GRAY, lambda p: px.brightness(p, 100)),
    "px_darker": _on(GRAY, lambda p: px.brightness(p, -100)),
    "px_threshold": _on(GRAY, px.threshold),
    "px_grayscale": _on(COLOUR, px.to_grayscale),
    "px_color_negative": _on(COLOUR, px.negative),
    "px_color_brightness": _on(COLOUR, lambda p: px.reorder_rgb(px.brightness(p, 100))),
    "px_color_threshold": _on(COLOUR, px.threshold),
    "px_channel_split": _on(COLOUR, lambda p: px.split_channels(p, ("red", "green", "blue", "luminance"))),
    "px_true_color": _on(fx.band_samples, px.true_colour),
    "img_shape": _on(GRAY, schema.image_shapes),
    "mean_filter_3": _on(GRAY, stencil.mean_filter),
    "mean_filter_color_5": _on(COLOUR, lambda p: stencil.mean_filter(p, 5)),
    "mean_filter_257": _on(GRAY, lambda p: stencil.mean_filter(p, 257)),
    "mean_filter_2049": _on(GRAY, lambda p: stencil.mean_filter(p, 2049)),
    "mean_filter_gray_nearest": _on(GRAY, lambda p: stencil.mean_filter(p, 5, rounding="nearest")),
    "laplacian": _on(GRAY, stencil.laplacian),
    "hist_exact": _on(GRAY, histogram.exact_histogram),
    "hist_rgb": _on(COLOUR, histogram.exact_histogram),
}


def _rounded_statistics(gray: DataFrame) -> DataFrame:
    stats = histogram.statistics(gray)
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})


QUERIES["img_statistics"] = _on(GRAY, _rounded_statistics)
QUERIES["bench_stats_lineitem"] = _on(fx.lineitem_pixels, lambda p: _rounded_statistics(px.to_grayscale(p)))
QUERIES["bench_hist_lineitem"] = _on(fx.lineitem_pixels, lambda p: histogram.level_counts(p, bytes_only=False))


def _plot(fixture: Query, **kw) -> Query:
    """Float sums differ in their last digits by order; densities are small, so they keep more places."""
    places_kept = 14 if kw.get("density") else 6

    def run(spark: SparkSession, sf: str) -> DataFrame:
        binned = histogram.plot_table(fixture(spark, sf), **kw)
        return binned.withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9), "mass": F.round("mass", places_kept)})

    return run


QUERIES |= {
    "hist_rebin_100": _plot(GRAY, bins=100),
    "hist_density": _plot(GRAY, bins=100, density=True),
    "hist_cumulative": _plot(GRAY, bins=100, cumulative=True),
    "hist_density_cumulative": _plot(GRAY, bins=100, density=True, cumulative=True),
    "hist_smoothed": _plot(COLOUR, mode="Smoothed", bins=64, smoothing=3),
    "hist_overlay": _plot(COLOUR, mode="RGB Overlay", bins=48, smoothing=8),
}


@_query
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    found = histogram.distinct_values(histogram.level_counts(GRAY(spark, sf)))
    return found.withColumn("levels", F.array_join("levels", ","))


@_query
def distinct_values_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.distinct_values(histogram.level_counts(fx.lineitem_pixels(spark, sf))).drop("levels")


# -- k-means and classification -------------------------------------------------------------------
def _model(spark: SparkSession, sf: str, k: int = 6, **kw) -> DataFrame:
    return cluster.kmeans(GRAY(spark, sf), k, **kw)


QUERIES |= {
    "kmeans_centroids": lambda spark, sf: cluster.centroid_table(_model(spark, sf)),
    "kmeans_ranges": lambda spark, sf: cluster.range_table(_model(spark, sf)),
    "kmeans_runs": lambda spark, sf: cluster.run_table(_model(spark, sf)),
    "kmeans_counts": lambda spark, sf: cluster.member_table(_model(spark, sf)),
    "kmeans_labels": lambda spark, sf: cluster.labels(GRAY(spark, sf), _model(spark, sf)),
    "kmeans_labels_150": lambda spark, sf: cluster.labels(GRAY(spark, sf), _model(spark, sf, 150)),
}


@_query
def kmeans_from_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.centroid_table(_model(spark, sf, ranges=default_ranges(6)))


@_query
def kmeans_from_edited_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A rerun that starts from the bounds a user has edited, image by image."""
    return cluster.centroid_table(_model(spark, sf, ranges=_edited_ranges(spark, sf)))


@_query
def kmeans_nearest_levels(spark: SparkSession, sf: str) -> DataFrame:
    nearest = cluster.nearest_lookup(F.col("centroids"))
    return _model(spark, sf).select("image_id", F.posexplode(nearest).alias("v", "cluster"))


def _edited_ranges(spark: SparkSession, sf: str) -> DataFrame:
    per_image = histogram.image_counts(GRAY(spark, sf)).select("image_id")
    preset = classify.range_counts(histogram.image_counts(GRAY(spark, sf)), default_ranges(6))
    return classify.edit_bounds(preset.select("image_id", "cluster", "lo", "hi"), fx.edited_bounds(per_image))


@_query
def classify_counts(spark: SparkSession, sf: str) -> DataFrame:
    return classify.range_counts(histogram.image_counts(GRAY(spark, sf)), default_ranges(6))


@_query
def classify_edit_bounds(spark: SparkSession, sf: str) -> DataFrame:
    counted = histogram.image_counts(GRAY(spark, sf))
    return classify.range_counts(counted, _edited_ranges(spark, sf))


@_query
def classify_recolor(spark: SparkSession, sf: str) -> DataFrame:
    return classify.recolour(GRAY(spark, sf), _edited_ranges(spark, sf), 6)


@_query
def classify_recolor_default(spark: SparkSession, sf: str) -> DataFrame:
    return classify.recolour(GRAY(spark, sf), default_ranges(9), 9)


@_query
def land_cover_legend(spark: SparkSession, sf: str) -> DataFrame:
    return classify.legend(histogram.image_counts(GRAY(spark, sf)), 6)


@_query
def land_cover_legend_9(spark: SparkSession, sf: str) -> DataFrame:
    return classify.legend(histogram.image_counts(GRAY(spark, sf)), 9)


@_query
def land_cover_legend_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram, Lloyd, ranges, counts, names: one plan, the pixels are read once."""
    return classify.model_legend(_model(spark, sf), 6)


@_query
def land_cover_map(spark: SparkSession, sf: str) -> DataFrame:
    return classify.land_cover_map(GRAY(spark, sf), _model(spark, sf), 6)


@_query
def map_recolor_bgr(spark: SparkSession, sf: str) -> DataFrame:
    return classify.display_image(GRAY(spark, sf), _model(spark, sf, 7), 7)


# -- clicks ---------------------------------------------------------------------------------------
def _measures(spark: SparkSession, sf: str) -> DataFrame:
    inside = measure.in_bounds(fx.clicks(spark, sf), schema.image_shapes(GRAY(spark, sf)))
    return measure.in_units(measure.measured(measure.pair_clicks(inside)))


@_query
def distance_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf).select("user_id", "event_id", "image_id", "x1", "y1", "x2", "y2", "distance")


@_query
def distance_units(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf).select("user_id", "event_id", "unit", "in_unit")


def _inspected(pixels: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    asked = fx.clicks(spark, sf).select("event_id", "image_id", "x", "y")
    return measure.inspect(asked, pixels).select("event_id", "image_id", "x", "y", "text")


@_query
def inspect_points(spark: SparkSession, sf: str) -> DataFrame:
    return _inspected(GRAY(spark, sf), spark, sf)


@_query
def inspect_points_color(spark: SparkSession, sf: str) -> DataFrame:
    return _inspected(COLOUR(spark, sf), spark, sf)


def _inspected_coded(pixels: DataFrame, spark: SparkSession, sf: str, colour: bool = False) -> DataFrame:
    """The same from coded segments, of which only the lanes under a click are decoded."""
    books = settled(huffman.code_books(pixels))
    asked = fx.clicks(spark, sf).select("event_id", "image_id", "x", "y")
    read = huffman.decode_points(huffman.encode(pixels, books), books, asked, colour)
    return measure.inspect(asked, read).select("event_id", "image_id", "x", "y", "text")


@_query
def inspect_points_coded(spark: SparkSession, sf: str) -> DataFrame:
    return _inspected_coded(GRAY(spark, sf), spark, sf)


@_query
def inspect_points_coded_color(spark: SparkSession, sf: str) -> DataFrame:
    return _inspected_coded(COLOUR(spark, sf), spark, sf, colour=True)


@_query
def decode_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A window of every image, read from its segments."""
    pixels = GRAY(spark, sf)
    books = settled(huffman.code_books(pixels))
    window = pixels.groupBy("image_id").agg(F.max("y").alias("bottom"), F.max("x").alias("right")).select(
        "image_id",
        F.floor(F.col("bottom") / 3).cast("int").alias("top"),
        F.floor(F.col("right") / 4).cast("int").alias("left"),
        F.floor(F.col("bottom") / 2).cast("int").alias("bottom"),
        F.floor(F.col("right") / 2).cast("int").alias("right"),
    )
    return huffman.decode_boxes(huffman.encode(pixels, books), books, window)


# -- places, scenes, prompts ----------------------------------------------------------------------
@_query
def resolve_places(spark: SparkSession, sf: str) -> DataFrame:
    return places.resolve(fx.names(spark, sf), fx.locations(spark, sf), fx.aliases(spark, sf))


_CORNERS = ("west", "south", "east", "north")


@_query
def place_bboxes(spark: SparkSession, sf: str) -> DataFrame:
    boxed = places.with_box(resolve_places(spark, sf).where("resolved"))
    return boxed.select("c_custkey", "code", *[F.round(f"box.{c}", 9).alias(c) for c in _CORNERS])


@_query
def scene_requests(spark: SparkSession, sf: str) -> DataFrame:
    manifest = places.scene_manifest(resolve_places(spark, sf))

    def part(path: str):
        return F.get_json_object("payload", f"$.{path}")

    corners = [
        F.round(part(f"input.bounds.bbox[{i}]").cast("double"), 9).alias(c) for i, c in enumerate(_CORNERS)
    ]
    return manifest.select(
        "c_custkey",
        "cache_key",
        part("output.width").cast("int").alias("width"),
        part("output.height").cast("int").alias("height"),
        *corners,
        part("input.data[0].type").alias("collection"),
        part("input.data[0].dataFilter.timeRange.from").alias("date_from"),
        part("input.data[0].dataFilter.timeRange.to").alias("date_to"),
        part("input.data[0].dataFilter.mosaickingOrder").alias("mosaicking"),
        part("evalscript").alias("script"),
    )


def _requests_and_cache(spark: SparkSession, sf: str, rule: str) -> tuple[DataFrame, DataFrame]:
    from rasterloom.functions.geo import cache_key

    asked = places.scene_manifest(resolve_places(spark, sf), rule)
    fetched = fx.table(spark, sf, "nation").where("n_nationkey < 10")
    return asked, fetched.select(cache_key(F.expr("concat('N-', n_nationkey)"), rule).alias("cache_key"))


@_query
def scenes_uncached(spark: SparkSession, sf: str) -> DataFrame:
    return places.uncached(*_requests_and_cache(spark, sf, "slash"))


@_query
def scenes_uncached_dash(spark: SparkSession, sf: str) -> DataFrame:
    return places.uncached(*_requests_and_cache(spark, sf, "dash"))


@_query
def scenes_cached(spark: SparkSession, sf: str) -> DataFrame:
    return places.cached(*_requests_and_cache(spark, sf, "slash"))


@_query
def points_in_sector(spark: SparkSession, sf: str) -> DataFrame:
    boxes = places.with_box(fx.locations(spark, sf))
    return places.points_in_boxes(fx.points(spark, sf), boxes).select("c_custkey", "code")


@_query
def least_cloud_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    best = places.least_cloudy(fx.scenes(spark, sf))
    return best.withColumn("ts", F.col("ts").cast("string"))


@_query
def scene_search(spark: SparkSession, sf: str) -> DataFrame:
    tiles = places.with_box(fx.locations(spark, sf)).select(F.col("code").alias("tile"), "box")
    area = F.struct(*[F.lit(v).alias(c) for c, v in zip(_CORNERS, (72.6, 33.2, 73.0, 33.9))])
    dated = places.scene_filter(fx.scenes(spark, sf), "1995-01-01", "1997-01-01")
    boxed = lookup_join(dated, tiles, ["tile"], "inner")
    return places.scene_filter(boxed, "1995-01-01", "1997-01-01", area).select("scene_id", "tile", "cloud_pct")


@_query
def scene_search_collection(spark: SparkSession, sf: str) -> DataFrame:
    found = places.scene_filter(fx.scenes(spark, sf), "1994-06-01", "1995-06-01", collection="sentinel-2-l2a")
    return found.select("scene_id", "tile", "collection", "cloud_pct")


@_query
def route_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.routed(fx.prompts(spark, sf)).drop("prompt")


@_query
def prompt_scene_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts to places of the built-in gazetteer to requests."""
    gazetteer_tables = places.built_in_locations(spark), places.built_in_aliases(spark)
    asked = prompts.requested_scenes(fx.prompts(spark, sf), *gazetteer_tables, literal=True)
    return asked.select("conv_id", "turn", "name", "code", "cache_key", "size.width", "size.height")


QUERIES["intent_counts"] = _on(fx.prompts, prompts.intent_counts)
QUERIES["clean_answers"] = _on(fx.answers, lambda a: prompts.cleaned(a).drop("answer"))


# -- interchange ----------------------------------------------------------------------------------
@_query
def ingest_csv_matrix(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "matrices")
    matrices.write_matrices(GRAY(spark, sf), folder)
    return matrices.read_matrices(spark, folder)


QUERIES["export_csv_matrix"] = _on(GRAY, matrices.matrix_lines)


@_query
def ingest_images(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "pngs")
    fx.write_pngs(COLOUR(spark, sf), folder)
    number = F.regexp_extract("path", r"(\d+)\.png$", 1)
    return images.colour_pixels(images.load_images(spark, f"{folder}/*.png", number))


def _loaded(spark: SparkSession, pixels: DataFrame) -> DataFrame:
    folder = new_folder(spark, "pngs")
    fx.write_pngs(pixels, folder)
    return images.load_images(spark, f"{folder}/*.png", F.regexp_extract("path", r"(\d+)\.png$", 1))


@_query
def ingest_images_gray(spark: SparkSession, sf: str) -> DataFrame:
    return images.gray_pixels(_loaded(spark, GRAY(spark, sf)))


@_query
def ingest_images_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return images.colour_pixels(_loaded(spark, COLOUR(spark, sf).drop("a")))


@_query
def ingest_runs(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "runs")
    notes = F.array(
        F.lit("operation=meanfilter"),
        F.concat(F.lit(" rows = "), "height"),
        F.concat(F.lit("cols="), "width"),
        F.lit("no separator here"),
        F.lit("note=a=b"),
    )
    shapes = schema.image_shapes(GRAY(spark, sf))
    runs.write_run_lines(shapes.select(F.col("image_id").alias("run"), F.explode(notes).alias("value")), folder)
    return runs.read_run_metadata(spark, folder).select("run", F.explode("metadata"))


@_query
def ingest_centroids(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "centroids")
    runs.write_run_lines(runs.centroid_lines(cluster.centroid_table(_model(spark, sf))), folder)
    return runs.read_centroids(spark, folder)


@_query
def centroid_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Stored centroids of a short run against those of a full one."""
    folder = new_folder(spark, "centroids")
    short = cluster.centroid_table(_model(spark, sf, max_iter=3))
    runs.write_run_lines(runs.centroid_lines(short), folder)
    read = runs.read_centroids(spark, folder).select(F.col("run").cast("long").alias("image_id"), "cluster", "centroid")
    return cluster.centroid_drift(read, _model(spark, sf))


@_query
def ingest_ranges(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "ranges")
    runs.write_run_lines(runs.range_lines(cluster.range_table(_model(spark, sf))), folder)
    return runs.read_ranges(spark, folder)


@_query
def parse_range_strings(spark: SparkSession, sf: str) -> DataFrame:
    compact = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["lo"], r["hi"])), ",")
    noisy = F.concat(F.lit("junk,"), compact, F.lit(","))
    return _model(spark, sf).select("image_id", F.inline(runs.parsed_ranges(noisy)))


@_query
def gazetteer_load(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "gazetteer")
    entry = F.struct("code", F.struct("lat", "lon"))
    sectors = fx.locations(spark, sf).agg(F.to_json(F.map_from_entries(F.collect_list(entry))))
    sectors.write.text(f"{folder}/sectors")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.upper("alias"), F.lower("code"))))
    fx.aliases(spark, sf).agg(F.to_json(pairs)).write.text(f"{folder}/aliases")
    known = gazetteer.read_locations(spark, f"{folder}/sectors")
    return gazetteer.read_aliases(spark, f"{folder}/aliases").join(known, "code").select("alias", "code", "lat", "lon")


@_query
def save_result(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "result")
    sinks.save_table(histogram.level_counts(GRAY(spark, sf)), folder)
    return spark.read.parquet(folder).drop("image_bucket")


@_query
def read_saved_box(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "ordered")
    sinks.save_ordered(GRAY(spark, sf), folder, block=4)
    return sinks.read_box(spark, folder, 3, 5, 11, 17, 30)


# -- chains and compression -----------------------------------------------------------------------
def _chain(spark: SparkSession, sf: str) -> chain.ChainResult:
    steps = [("negative", {}), ("meanfilter", {"window": 3}), ("threshold", {})]
    return chain.run_chain(GRAY(spark, sf), steps)


QUERIES["operation_chain"] = lambda spark, sf: _chain(spark, sf).image


@_query
def operation_chain_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).metadata.select("image_id", "step", "operation", F.explode("metadata"))


def _after(steps: list[tuple[str, dict]], fixture: Query = GRAY) -> Query:
    return lambda spark, sf: chain.run_chain(fixture(spark, sf), steps).image


def _notes(result: chain.ChainResult) -> DataFrame:
    return result.metadata.select("image_id", "step", "operation", F.explode("metadata"))


QUERIES |= {
    "chain_kmeans": _after([("kmeans", {"K": 6})]),
    "chain_laplacian": _after([("negative", {}), ("laplacian", {})]),
    "chain_gray_brightness": _after([("grayscale", {}), ("brightness", {"value": 40})], COLOUR),
    "chain_compress": _on(GRAY, lambda p: _notes(chain.run_chain(p, [("huffman_compress", {})]))),
    "chain_prompts": _on(
        GRAY, lambda p: chain.run_prompts(p, ["make it negative", "What is this?", "Show F-7", "now a mean filter"]).image
    ),
}


@_query
def chain_statistics(spark: SparkSession, sf: str) -> DataFrame:
    found = chain.run_chain(GRAY(spark, sf), [("negative", {}), ("statistics", {})]).tables[1]
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})


@_query
def chain_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics and sizes along a chain of pointwise steps, all from levels counted once."""
    steps = [("huffman_compress", {}), ("negative", {}), ("statistics", {}), ("brightness", {"value": 60}), ("statistics", {}), ("threshold", {"value": 200}), ("statistics", {})]
    result = chain.run_chain(GRAY(spark, sf), [*steps, ("compress", {})])
    tables = [table.withColumn("step", F.lit(step)) for step, table in result.tables.items()]
    found = reduce(DataFrame.unionByName, tables).withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})
    levels = result.metadata.where(F.col("step") == len(steps)).select("image_id", F.col("metadata")["unique_values"].cast("int").alias("last_levels"))
    return found.join(levels, "image_id")


@_query
def chain_histogram(spark: SparkSession, sf: str) -> DataFrame:
    binned = chain.run_chain(GRAY(spark, sf), [("histogram", {"bins": 100})]).tables[0]
    return binned.withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9), "mass": F.round("mass", 6)})


@_query
def chain_distance(spark: SparkSession, sf: str) -> DataFrame:
    asked = _measures(spark, sf).select("image_id", "x1", "y1", "x2", "y2")
    return _notes(chain.run_chain(None, [("distance", {"points": asked})]))


@_query
def chain_decompress(spark: SparkSession, sf: str) -> DataFrame:
    pixels = GRAY(spark, sf)
    books = settled(huffman.code_books(pixels))
    segments = huffman.encode(pixels, books, segment=700)
    return chain.run_chain(None, [("huffman_decompress", {"segments": segments, "books": books})]).image


QUERIES |= {
    "huffman_codes": _on(GRAY, lambda p: huffman.code_table(huffman.code_books(p))),
    "huffman_sizes": _on(GRAY, lambda p: huffman.sizes(huffman.code_books(p), colour=False)),
    "huffman_sizes_color": _on(COLOUR, lambda p: huffman.sizes(huffman.code_books(p), colour=True)),
}


@_query
def huffman_segments(spark: SparkSession, sf: str) -> DataFrame:
    pixels = GRAY(spark, sf)
    coded = huffman.encode(pixels, huffman.code_books(pixels), segment=1000)
    return coded.select("image_id", "seg", "n_values", "payload_bits", F.hex("payload").alias("payload"))


def _roundtrip(pixels: DataFrame, colour: bool = False) -> DataFrame:
    books = settled(huffman.code_books(pixels))
    return huffman.decode(huffman.encode(pixels, books), books, colour)


QUERIES["huffman_roundtrip"] = _on(GRAY, _roundtrip)
QUERIES["huffman_roundtrip_color"] = _on(COLOUR, lambda p: _roundtrip(p, True))
QUERIES["huffman_roundtrip_rgb"] = lambda spark, sf: _roundtrip(ingest_images_rgb(spark, sf), True)


@_query
def huffman_roundtrip_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """A fleet in which every other image has no alpha."""
    alpha = F.when(F.col("image_id") % 2 == 1, F.col("a"))
    return _roundtrip(COLOUR(spark, sf).withColumn("a", alpha), True)


@_query
def huffman_lossless(spark: SparkSession, sf: str) -> DataFrame:
    pixels = GRAY(spark, sf)
    return huffman.differing_pixels(pixels, _roundtrip(pixels)).agg(F.count(F.lit(1)).alias("differing"))


@_query
def huffman_audit(spark: SparkSession, sf: str) -> DataFrame:
    pixels = GRAY(spark, sf)
    heads = huffman.container_heads(huffman.code_books(pixels), schema.image_shapes(pixels), colour=False)
    return huffman.audit(heads)


@_query
def huffman_audit_files(spark: SparkSession, sf: str) -> DataFrame:
    """Gray and colour containers as files, most of them damaged."""
    folder = new_folder(spark, "containers")
    for name, pixels, channels in (("gray", GRAY(spark, sf), 1), ("colour", COLOUR(spark, sf), 4)):
        heads = huffman.container_heads(huffman.code_books(pixels), schema.image_shapes(pixels), name == "colour", channels)
        fx.write_containers(heads.withColumn("path", F.concat(F.lit(f"{name}-"), "path")), f"{folder}/{name}")
    found = huffman.audit(containers.read_containers(spark, f"{folder}/*/*.bin"))
    return found.withColumn("path", F.regexp_extract("path", r"([^/]+)\.bin$", 1))
