"""Files of a folder, those without any byte included (a scan leaves them out), and numbers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def one_slash(path: Column) -> Column:
    """The same path with one slash after ``file:``."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def plain_path(uri: Column) -> Column:
    """Path of a file URI, without percent escapes."""
    return one_slash(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of every file. The list is the one that Spark's driver makes for any scan; Python never holds it."""
    found = spark.read.format("binaryFile").load(path)._jdf.inputFiles()  # stays in the JVM
    return spark.range(1).select(F.explode(F.lit(found)).alias("uri")).select(plain_path(F.col("uri")).alias("path"))


def empty_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path) of the files without any byte; None if there are none, which counting shows."""
    files = spark.read.format("binaryFile").load(path)
    if len(files._jdf.inputFiles()) == files.select("path").count():
        return None
    return listed_files(spark, path).join(files.select(one_slash(F.col("path")).alias("path")), "path", "left_anti")


def path_number(path: Column, paths: DataFrame) -> Column:
    """A 64-bit number of a path; the job fails if two of ``paths`` (path) have the same one."""
    seen = paths.select("path").distinct().groupBy(F.xxhash64("path").alias("n")).agg(F.min("path").alias("a"), F.max("path").alias("b"))
    clash = seen.where("a <> b").agg(F.min(F.concat("a", F.lit(" and "), "b"))).scalar()
    refused = F.raise_error(F.concat(F.lit("files with the same number: "), clash))
    return F.when(clash.isNotNull(), refused.cast("long")).otherwise(F.xxhash64(path))
