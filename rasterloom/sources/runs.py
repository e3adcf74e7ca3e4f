"""Key-value files of many runs: metadata, centroids, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom.functions.pixel import round_half_away
from rasterloom.functions.text import strip
from rasterloom.sources.lines import PLACE, placed_lines


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(run, key, value) of ``key=value`` lines; the run is the ``run=`` folder, else the file.

    A line is split at its first ``=``; lines without one are skipped; a repeated key keeps its last line.
    """
    foldered = "run" in spark.read.text(path).columns
    lines = placed_lines(spark, path)
    run = F.col("run").cast("string") if foldered else F.col("path")
    pairs = lines.where(F.col("value").contains("=")).select(
        run.alias("run"),
        F.struct(*PLACE).alias("place"),
        strip(F.substring_index("value", "=", 1)).alias("key"),
        strip(F.expr("substring(value, instr(value, '=') + 1)")).alias("value"),
    )
    return pairs.groupBy("run", "key").agg(F.max_by("value", "place").alias("value"))


def read_run_metadata(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """(run, metadata MAP); runs of ``expected`` without a file get an empty map."""
    entries = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    runs = key_values(spark, path).groupBy("run").agg(entries.alias("metadata"))
    if expected is None:
        return runs
    empty = F.create_map().cast("map<string,string>")
    return expected.select("run").join(runs, "run", "left").withColumn("metadata", F.coalesce("metadata", empty))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(run, cluster, centroid) of ``id=int`` lines; centroids were rounded when written."""
    return key_values(spark, path).select(
        "run", F.col("key").cast("int").alias("cluster"), F.col("value").cast("int").alias("centroid")
    )


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(run, cluster, lo, hi) of ``id=lo-hi`` lines."""
    bounds = F.split("value", "-", 2)
    return key_values(spark, path).select(
        "run",
        F.col("key").cast("int").alias("cluster"),
        F.trim(bounds[0]).cast("int").alias("lo"),
        F.trim(bounds[1]).cast("int").alias("hi"),
    )


def parsed_ranges(text: Column) -> Column:
    """array<struct<cluster, lo, hi>> of a compact ``lo-hi,lo-hi`` string.

    Tokens without a dash are skipped; the position among the rest is the cluster.
    """
    tokens = F.filter(F.split(text, ","), lambda t: F.contains(t, F.lit("-")))
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            i.alias("cluster"),
            F.trim(F.split(t, "-", 2)[0]).cast("int").alias("lo"),
            F.trim(F.split(t, "-", 2)[1]).cast("int").alias("hi"),
        ),
    )


def centroid_lines(centroids: DataFrame) -> DataFrame:
    """(run, value): the ``id=int`` lines of a centroid table."""
    rounded = round_half_away(F.col("centroid"))
    return centroids.select(F.col("image_id").alias("run"), F.concat_ws("=", "cluster", rounded).alias("value"))


def range_lines(ranges: DataFrame) -> DataFrame:
    """(run, value): the ``id=lo-hi`` lines of a range table."""
    return ranges.select(
        F.col("image_id").alias("run"), F.concat_ws("=", "cluster", F.concat_ws("-", "lo", "hi")).alias("value")
    )


def write_run_lines(lines: DataFrame, folder: str) -> None:
    """Write (run, value) lines below ``run=`` folders."""
    lines.select("run", "value").write.partitionBy("run").text(folder)
