"""Headerless integer CSV matrices: one image per file, one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom.functions.pixel import clamp_int
from rasterloom.schema import checked_level
from rasterloom.sources.lines import files_without_lines, numbered_lines, split_counts
from rasterloom.sources.listing import path_number


def read_matrices(
    spark: SparkSession,
    path: str,
    image_id: Column | None = None,
    clamp: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Gray pixels of every matrix file below ``path``.

    The image is the ``image_id=`` folder of a file if there is one, else ``image_id``, an expression
    over the column ``path`` (by default its hash). ``clamp`` limits cells to 0..255; without it a cell
    outside fails the job. ``strict`` fails on files without any row. The text is read twice: now, to count the lines
    of its splits, and when the pixels are wanted.
    """
    foldered = "image_id" in spark.read.text(path).columns
    key = "image_id" if foldered else None
    splits = split_counts(spark, path, key)
    lines = numbered_lines(spark, path, key, splits)
    if strict and (empty := files_without_lines(spark, path, splits)) is not None:
        names = [row.path for row in empty.limit(10).collect()]
        if names:
            raise ValueError(f"input matrix is empty: {names}")
    if foldered:
        image = F.col("image_id").cast("long")
    else:
        number = path_number(F.col("path"), splits) if image_id is None else image_id
        image = number.cast("long")
    cells = lines.select(image.alias("image_id"), F.col("line").cast("int").alias("y"), F.posexplode(F.split("value", ",")).alias("x", "cell"))
    refused = F.raise_error(F.concat(F.lit("not an integer matrix cell: "), F.col("cell")))
    value = F.coalesce(F.trim("cell").try_cast("long"), refused.cast("long"))
    level = clamp_int(value, 0, 255) if clamp else checked_level(value)
    return cells.select("image_id", "y", "x", level.cast("int").alias("v"))


def matrix_lines(pixels: DataFrame) -> DataFrame:
    """(image_id, y, value): one CSV line per pixel row, cells in x order, clamped to 0..255."""
    cell = F.struct("x", clamp_int(F.col("v"), 0, 255).alias("v"))
    ordered = F.array_sort(F.collect_list(cell))["v"]
    return pixels.groupBy("image_id", "y").agg(F.array_join(ordered.cast("array<string>"), ",").alias("value"))


def write_matrices(pixels: DataFrame, folder: str) -> None:
    """Write CSV matrices below ``image_id=`` folders, rows in y order across the files of a folder."""
    lines = matrix_lines(pixels).repartitionByRange("image_id", "y").sortWithinPartitions("image_id", "y")
    lines.select("image_id", "value").write.partitionBy("image_id").text(folder)
