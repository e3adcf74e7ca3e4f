"""Result tables as Parquet (S13), and boxes read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = 64  # edge of the squares of pixels that the curve of `save_ordered` goes through


def save_table(result: DataFrame, folder: str, buckets: int = 64, mode: str = "error") -> None:
    """Write a table keyed by ``image_id`` below ``image_bucket=`` folders.

    The rebalance hint groups rows by bucket and lets adaptive execution split a bucket that one large
    image fills, and merge small ones.
    """
    bucketed = result.withColumn("image_bucket", F.pmod("image_id", F.lit(buckets)).cast("int"))
    bucketed.hint("rebalance", "image_bucket").write.mode(mode).partitionBy("image_bucket").parquet(folder)


def save_bucketed(result: DataFrame, table: str, buckets: int = 1024, mode: str = "error") -> None:
    """Write a catalog table bucketed by ``image_id``.

    A join of it with a per-image table then shuffles only the per-image side. That is the layout for
    fleets whose per-image tables are too large to broadcast.
    """
    result.write.mode(mode).bucketBy(buckets, "image_id").sortBy("image_id").saveAsTable(table)


def _curve(block: int) -> Column:
    """The place of a pixel's square on a curve in Z-order: the bits of its row and column by turns."""
    down, across = (F.floor(F.col(c) / block).cast("long") for c in ("y", "x"))
    bit = lambda value, i: F.shiftright(value, i).bitwiseAND(F.lit(1).cast("long"))
    parts = [F.shiftleft(bit(v, i), 2 * i + odd) for i in range(31) for odd, v in ((0, across), (1, down))]
    while len(parts) > 1:  # a flat tree of additions
        parts = [sum(parts[i + 1 : i + 2], parts[i]) for i in range(0, len(parts), 2)]
    return parts[0]


def save_ordered(pixels: DataFrame, folder: str, files: int | None = None, block: int = BLOCK, mode: str = "error") -> None:
    """Write a pixel table so that neighbours in an image lie together, for :func:`read_box`.

    Pixels are ranged by image and by the Z-order of their square, in one shuffle, into ``files`` files (by default as
    many as there are shuffle partitions, less those that adaptive execution merges). Ranges come from a sample, so one
    huge image is many files and small ones share a file.
    """
    keys = [F.col("image_id"), F.col("_curve"), F.col("y"), F.col("x")]
    placed = pixels.withColumn("_curve", _curve(block))
    ranged = placed.repartitionByRange(files, *keys) if files else placed.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).drop("_curve").write.mode(mode).parquet(folder)


def read_box(spark: SparkSession, folder: str, image_id: int, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Pixels of one image inside a box, edges included.

    The conditions reach the scan, which skips files and row groups by their smallest and largest values.
    """
    inside = F.col("y").between(top, bottom) & F.col("x").between(left, right)
    return spark.read.parquet(folder).where((F.col("image_id") == image_id) & inside)
