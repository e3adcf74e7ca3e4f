"""Compressed image containers (H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.sources.heads import Open, file_heads
from rasterloom.sources.listing import empty_files

HEAD_BYTES = 4 + 4 * fixed.COLOUR_FIELDS + fixed.COUNT_TABLE_BYTES


def read_containers(spark: SparkSession, path: str, opener: Open | None = None) -> DataFrame:
    """(path, length, content) of every file below ``path``, ready for ``huffman.audit``.

    ``content`` is the head of a file, fields and count table; the payload is never read. ``opener`` replaces the way
    files are opened.
    """
    full = file_heads(spark, path, HEAD_BYTES, opener)
    empty = empty_files(spark, path)
    if empty is None:
        return full
    return full.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
