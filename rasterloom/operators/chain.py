"""Named operations in a row over a pixel table, with their run metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.functions import geo
from rasterloom.operators import cluster, histogram, huffman, pixels as px, prompts, stencil
from rasterloom.schema import image_shapes, is_colour
from rasterloom.session import settle, stored

Params = dict[str, object]


@dataclass
class ChainResult:
    """What a chain leaves: pixels, one metadata row per image and step, tables by step, log lines."""

    image: DataFrame | None
    metadata: DataFrame | None
    tables: dict[int, DataFrame] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)


@dataclass
class _Step:
    image: DataFrame
    notes: dict[str, object]
    per_image: DataFrame | None = None  # (image_id, found MAP)
    table: DataFrame | None = None


# what a step sees: the image, its counted levels or the image itself, and the shapes
_Apply = Callable[[DataFrame, DataFrame, DataFrame, Params], _Step]


def _int(params: Params, key: str, default: int) -> int:
    return int(params.get(key, default))


def _grayscale(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    return _Step(px.to_grayscale(image), {})


def _negative(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    return _Step(px.negative(image), {})


def _brightness(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    value = _int(params, "value", fixed.BRIGHTNESS)
    return _Step(px.brightness(image, value), {"value": value})


def _threshold(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    value = _int(params, "value", fixed.THRESHOLD)
    return _Step(px.threshold(image, value), {"value": value})


def _mean_filter(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    window = max(fixed.MEAN_WINDOW, _int(params, "window", fixed.MEAN_WINDOW) | 1)
    return _Step(stencil.mean_filter(image, window), {"window": window})


def _laplacian(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    return _Step(stencil.laplacian(px.to_grayscale(image)), {})


def _kmeans(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    lo, hi = fixed.KMEANS_K_LIMITS
    k = max(lo, min(_int(params, "K", _int(params, "value", fixed.KMEANS_K)), hi))
    gray = px.to_grayscale(image)
    ranges = params.get("ranges")
    if isinstance(ranges, str):
        ranges = [tuple(int(b) for b in token.split("-", 1)) for token in ranges.split(",") if "-" in token]
    model = cluster.kmeans(px.to_grayscale(levels), k, _int(params, "maxIter", fixed.KMEANS_MAX_ITER), ranges)
    labelled = cluster.labels(gray, model).withColumnRenamed("cluster", "v")
    return _Step(labelled, {"clusters": k})


def _compress(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    report = huffman.sizes(huffman.code_books(levels), is_colour(image))
    names = ["original_bytes", "compressed_bytes", "payload_bits", "unique_values"]
    notes = F.create_map(*[part for n in names for part in (F.lit(n), F.col(n).cast("string"))])
    return _Step(image, {}, report.select("image_id", notes.alias("found")))


def _statistics(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    return _Step(image, {}, table=histogram.statistics(px.to_grayscale(levels)))


def _histogram(image: DataFrame, levels: DataFrame, shapes: DataFrame, params: Params) -> _Step:
    modes = {key: params[key] for key in ("mode", "bins", "density", "cumulative", "smoothing") if key in params}
    return _Step(image, {}, table=histogram.plot_table(levels, **modes))


OPERATIONS: dict[str, _Apply] = {
    "grayscale": _grayscale,
    "negative": _negative,
    "brightness": _brightness,
    "threshold": _threshold,
    "meanfilter": _mean_filter,
    "laplacian": _laplacian,
    "kmeans": _kmeans,
    "huffman_compress": _compress,
    "statistics": _statistics,
    "histogram": _histogram,
}

# names under which prompts ask for an operation
ALIASES = {"compress": "huffman_compress"}

# these leave no metadata behind
SILENT = {"laplacian", "statistics", "histogram"}
# these shuffle pixels; what follows should not do it again
HEAVY = {"meanfilter", "laplacian", "kmeans"}
# these read their pixels more than once
REPEATED = {"meanfilter", "laplacian", "kmeans", "huffman_compress", "histogram"}
# these need only the levels of a gray image, counted once
COUNTED = {"kmeans", "huffman_compress", "statistics", "histogram"}
# these change a gray level to another one, so they change counted levels as they change pixels
POINTWISE = {"grayscale", "negative", "brightness", "threshold"}

NAMES = {*OPERATIONS, "distance", "huffman_decompress"}


def _metadata(shapes: DataFrame, number: int, name: str, step: _Step) -> DataFrame:
    """(image_id, step, operation, metadata); no operation changes the shape of an image."""
    constant = {"operation": name, **step.notes}
    parts: list[Column] = [F.lit(str(part)) for pair in constant.items() for part in pair]
    for key, column in (("rows", "height"), ("cols", "width")):
        parts += [F.lit(key), F.col(column).cast("string")]
    notes = F.create_map(*parts)
    if step.per_image is not None:
        shapes = shapes.join(step.per_image, "image_id")
        notes = F.map_concat(notes, F.col("found"))
    return shapes.select(
        "image_id", F.lit(number).alias("step"), F.lit(name).alias("operation"), notes.alias("metadata")
    )


def run_chain(image: DataFrame | None, steps: list[tuple[str, Params]]) -> ChainResult:
    """Apply named operations one after the other.

    ``distance`` measures a table of point pairs given as parameter ``points`` and leaves the image as it
    is; ``huffman_decompress`` starts from ``segments`` and ``books``; ``statistics`` and ``histogram`` put a
    table into the result.

    The levels of a gray image are counted once, at the first step that asks for them. Pointwise steps are applied to
    the 256 counts as well as to the pixels, so statistics, histograms, sizes and cluster models further down the
    chain do not look at a pixel again, until a step moves pixels or labels them.

    Jobs that run now: the shapes of the images are settled once, for the metadata of all steps, and so are counted
    levels; pixels that came out of a shuffle are written to the shared folder before a step that reads them more than
    once; and ``kmeans`` settles its lookups. Everything else is left to the caller's action.
    """
    result = ChainResult(image, None)
    shapes = None if image is None else settle(image_shapes(image))
    heavy, levels = False, None
    for number, (asked, params) in enumerate(steps):
        name = ALIASES.get(asked, asked)
        if not name:
            raise ValueError("No operation specified")
        if name not in NAMES:
            raise ValueError(f"Unsupported operation: {name}")
        result.log.append(f"Operation: {name}")
        if name == "distance":
            _add(result, _distance_metadata(params["points"], number))
            continue
        if name == "huffman_decompress":
            result.image = huffman.decode(params["segments"], params["books"], _int(params, "channels", 1) > 1)
            result.image = stored(result.image)
            shapes, levels = settle(image_shapes(result.image)), None
            _add(result, _metadata(shapes, number, name, _Step(result.image, {})))
            continue
        if result.image is None:
            raise ValueError(f"Operation requires an image: {name}")
        if heavy and name in REPEATED:
            result.image, heavy = stored(result.image), False
        if name in COUNTED and levels is None and not is_colour(result.image):
            levels = histogram.counted_levels(result.image)
        step = OPERATIONS[name](result.image, result.image if levels is None else levels, shapes, params)
        if name in POINTWISE and levels is not None:
            levels = OPERATIONS[name](levels, levels, shapes, params).image
        elif name in HEAVY:
            levels = None
        heavy |= name in HEAVY
        if name not in SILENT:
            _add(result, _metadata(shapes, number, name, step))
        if step.table is not None:
            result.tables[number] = step.table
        result.image = step.image
    result.log.append("Done!")
    return result


def run_prompts(image: DataFrame, texts: list[str], params: dict[str, Params] | None = None) -> ChainResult:
    """Apply the operations that prompts ask for, in their order; other prompts are passed over.

    ``texts`` is one user's dialogue, not a table. ``params`` holds parameters by the name a prompt is routed to; the
    others have their defaults. ``distance`` is measured only with ``points`` in its parameters.
    """
    frame = image.sparkSession.createDataFrame(list(enumerate(texts)), "turn INT, prompt STRING")
    asked = [r["operation"] for r in sorted(prompts.operations(frame).collect(), key=lambda r: r["turn"])]
    params = params or {}
    return run_chain(image, [(name, params.get(name, {})) for name in asked if name != "distance" or "points" in params.get(name, {})])


def _add(result: ChainResult, rows: DataFrame) -> None:
    result.metadata = rows if result.metadata is None else result.metadata.unionByName(rows)


def _distance_metadata(points: DataFrame, number: int) -> DataFrame:
    corners = [F.coalesce(F.col(c), F.lit(0)) for c in ("x1", "y1", "x2", "y2")]
    distance = F.format_string("%.3f", geo.pixel_distance(*corners))
    notes = F.create_map(
        F.lit("operation"),
        F.lit("distance"),
        *[part for n, c in zip(("x1", "y1", "x2", "y2"), corners) for part in (F.lit(n), c.cast("string"))],
        F.lit("distance"),
        distance,
    )
    return points.select(
        F.col("image_id"), F.lit(number).alias("step"), F.lit("distance").alias("operation"), notes.alias("metadata")
    )
