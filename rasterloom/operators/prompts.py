"""Prompt tables: routing, counts per intent, cleaned answers (T1..T3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterloom.functions import text
from rasterloom.operators.places import resolve, scene_manifest


def routed(prompts: DataFrame) -> DataFrame:
    """Add intent, location, operation and question to a ``prompt`` column."""
    return prompts.withColumn("_route", text.route(F.col("prompt"))).select(*prompts.columns, "_route.*")


def intent_counts(prompts: DataFrame) -> DataFrame:
    """Prompts per intent and operation."""
    return routed(prompts).groupBy("intent", "operation").agg(F.count(F.lit(1)).alias("n"))


def requested_scenes(prompts: DataFrame, locations: DataFrame, aliases: DataFrame, literal: bool = False) -> DataFrame:
    """Scene requests of the prompts that ask for imagery of a known place, with box, size and payload.

    ``literal`` says that the gazetteer's tables are small by construction, as the built-in ones are.
    """
    asked = routed(prompts).where("intent = 'fetch_satellite'").withColumnRenamed("location", "name")
    return scene_manifest(resolve(asked.drop("intent", "operation", "question"), locations, aliases, literal=literal))


def operations(prompts: DataFrame) -> DataFrame:
    """The prompts that ask for an operation on the image, with its name; see ``chain.run_prompts``."""
    return routed(prompts).where("intent = 'process_image'").drop("intent", "location", "question")


def cleaned(answers: DataFrame) -> DataFrame:
    """Add ``cleaned``, the ``answer`` column without reasoning."""
    return answers.withColumn("cleaned", text.clean_answer(F.col("answer")))
