"""Image files as pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom.schema import PIXELS, PIXELS_BGR
from rasterloom.sources.heads import Open, Read, from_ranges
from rasterloom.sources.listing import one_slash, path_number

_STRIP_BYTES = 64 * 1024


def load_images(spark: SparkSession, path: str, image_id: Column | None = None, opener: Open | None = None) -> DataFrame:
    """(image_id, path, height, width, n_channels, data) with the channels an image was stored with.

    ``image_id`` is an expression over the column ``path``, by default its hash; the job fails if two files have
    the same one. Files that no decoder reads stay in the table with height -1; see :func:`unreadable`. The job
    fails on files of more than 8 bits per sample, whose values the decoder would cut; that is told from ranges of the
    files, which ``opener`` reads in its own way if given.
    """
    files = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    named = files.withColumnRenamed("origin", "path")
    listed = spark.read.format("binaryFile").load(path).select(one_slash(F.col("path")).alias("path"))
    number = path_number(one_slash(F.col("path")), listed) if image_id is None else image_id
    deep = from_ranges(spark, path, declared_bits, "int", opener).where("found > 8").agg(F.min("path")).scalar()
    refused = F.raise_error(F.concat(F.lit("more than 8 bits per sample: "), deep))
    return named.select(
        number.cast("long").alias("image_id"),
        "path",
        F.when(deep.isNotNull(), refused.cast("int")).otherwise(F.col("height")).alias("height"),
        "width",
        F.col("nChannels").alias("n_channels"),
        "data",
    )


def sample_bits(content: bytes) -> int | None:
    """Bits per sample that a PNG, TIFF or JPEG file declares; None for other files."""
    return declared_bits(lambda at, n: content[at : at + n])


def declared_bits(read: Read) -> int | None:
    """The same, looking at a few ranges of the file: its head, a TIFF's directory, a JPEG's markers."""
    head = read(0, 26)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) > 24:
        return head[24]
    if head[:4] in (b"II*\0", b"MM\0*"):
        order = "little" if head[:2] == b"II" else "big"
        number = lambda at, n: int.from_bytes(read(at, n), order)
        first = number(4, 4)
        entries = read(first + 2, 12 * number(first, 2))
        for at in range(0, len(entries) - 11, 12):
            if int.from_bytes(entries[at : at + 2], order) == 258:  # BitsPerSample, in place if it has at most two values
                count = int.from_bytes(entries[at + 4 : at + 8], order)
                place = first + 2 + at + 8 if count <= 2 else int.from_bytes(entries[at + 8 : at + 12], order)
                return max((number(place + 2 * i, 2) for i in range(min(count, 16))), default=1)
        return 1
    if head[:2] == b"\xff\xd8":
        at = 2
        while len(marker := read(at, 10)) == 10 and marker[0] == 0xFF:
            kind = marker[1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return marker[4]
            at += 2 + int.from_bytes(marker[2:4], "big")
    return None


def unreadable(images: DataFrame) -> DataFrame:
    return images.where("height <= 0 OR width <= 0").select("image_id", "path")


def _strips(images: DataFrame) -> DataFrame:
    """Row strips of bounded size, so that one large image is many rows."""
    line = F.col("width") * F.col("n_channels")
    step = F.greatest(F.lit(1), F.floor(_STRIP_BYTES / line)).cast("int")
    starts = images.where("height > 0 AND width > 0").withColumn("step", step).withColumn(
        "top", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.col("step")))
    )
    rows = F.least(F.col("step"), F.col("height") - F.col("top"))
    data = F.expr("substring(data, top * width * n_channels + 1, step * width * n_channels)")
    return starts.select("image_id", "top", rows.alias("rows"), "width", "n_channels", data.alias("data"))


def _pixels_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for strip in batch.to_pylist():
            rows, width, channels = strip["rows"], strip["width"], strip["n_channels"]
            values = np.frombuffer(strip["data"], np.uint8).reshape(rows * width, channels).astype(np.int32)
            columns = [
                np.full(rows * width, strip["image_id"], np.int64),
                np.repeat(np.arange(strip["top"], strip["top"] + rows, dtype=np.int32), width),
                np.tile(np.arange(width, dtype=np.int32), rows),
                *(values[:, i] for i in range(channels)),
            ]
            arrays = [pa.array(c) for c in columns]
            if len(arrays) < 3 + len(names):
                arrays.append(pa.nulls(rows * width, pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=["image_id", "y", "x", *names])


def gray_pixels(images: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of the one-channel images."""
    return _strips(images.where("n_channels = 1")).mapInArrow(lambda it: _pixels_of(it, ["v"]), PIXELS)


def colour_pixels(images: DataFrame) -> DataFrame:
    """(image_id, y, x, b, g, r, a) of the colour images; a is null without an alpha channel."""
    strips = _strips(images.where("n_channels IN (3, 4)"))
    return strips.mapInArrow(lambda it: _pixels_of(it, ["b", "g", "r", "a"]), PIXELS_BGR)


def image_sizes(images: DataFrame) -> DataFrame:
    """(image_id, height, width, n_pixels) without looking at a pixel."""
    return images.where("height > 0").select(
        "image_id", "height", "width", (F.col("height").cast("long") * F.col("width")).alias("n_pixels")
    )
