"""Numbered lines of many text files, of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rasterloom.operators.lookup import lookup_join
from rasterloom.session import settle
from rasterloom.sources.listing import listed_files, plain_path

# columns that put the lines of a text in order: file, split of the file, place in the split
PLACE = ("path", "block", "at")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value) plus the partition columns of the folder; blank lines are left out.

    Files are split across tasks; ``at`` grows along a split.
    """
    raw = spark.read.text(path)
    extra = [c for c in raw.columns if c != "value"]
    return raw.where(F.length("value") > 0).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        *extra,
        "value",
    )


def split_counts(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(path, block, first_at, n_lines) and ``key`` of every split with a line: the first of two readings of the text.

    Computed now, and held as a checkpoint of a row per split, from which the files that were read are known too.
    """
    lines = placed_lines(spark, path)
    names = dict.fromkeys([*([key] if key else []), "path", "block"])
    return settle(lines.groupBy(*names).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n_lines")))


def numbered_lines(spark: SparkSession, path: str, key: str | None = None, splits: DataFrame | None = None) -> DataFrame:
    """(path, line, value) plus the partition columns of the folder; blank lines take no number.

    A split's first line number is the sum of the splits before it, so lines are never sorted, shuffled or copied; the
    text is read twice, once to count, unless ``splits`` brings the counts. ``key`` names a partition column whose
    files, in name order, form one text. The first numbers are broadcast if their measured bytes fit.
    """
    lines = placed_lines(spark, path)
    extra = [c for c in lines.columns if c not in (*PLACE, "value")]
    splits = split_counts(spark, path, key) if splits is None else splits
    before = Window.partitionBy(key or "path").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "block", "first_at", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("start"), "n_lines")
    numbered = lookup_join(lines, starts, ["path", "block"], how="inner", weight="n_lines")
    return numbered.select("path", *extra, (F.col("at") - F.col("first_at") + F.col("start")).alias("line"), "value")


def files_without_lines(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame | None:
    """Files below ``path`` that gave no line at all; None if there are none, which their number shows."""
    read = splits.select(plain_path(F.col("path")).alias("path")).distinct()
    if len(spark.read.text(path)._jdf.inputFiles()) == read.count():
        return None
    return listed_files(spark, path).join(read, "path", "left_anti")
