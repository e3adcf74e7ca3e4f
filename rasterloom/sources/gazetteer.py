"""Gazetteer and alias JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _entries(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """(order, key, value) of JSON objects, one object per file."""
    files = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string,{value_type}>", {"mode": "FAILFAST"})
    return files.select(F.posexplode(F.map_entries(parsed)).alias("at", "entry")).select("at", "entry.key", "entry.value")


def _last(entries: DataFrame, key: Column, name: str) -> DataFrame:
    return entries.groupBy(key.alias(name)).agg(F.max_by("value", "at").alias("value"))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """(code, lat, lon) of an object ``{code: {lat, lon}}``; codes in upper case."""
    entries = _entries(spark, path, "struct<lat:double,lon:double>")
    return _last(entries, F.upper("key"), "code").select("code", "value.lat", "value.lon")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, code) of an object ``{alias: code}``; alias in lower, code in upper case, last one wins."""
    entries = _entries(spark, path, "string")
    return _last(entries, F.lower("key"), "alias").select("alias", F.upper("value").alias("code"))
