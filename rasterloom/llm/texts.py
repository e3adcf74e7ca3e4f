"""Rows by their text: a hash that names a row's text, and fetching the texts of chosen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators.lookup import fits_broadcast

FETCH_BYTES = 32 << 20


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def fetch(docs: DataFrame, wanted: DataFrame, row_bytes: int, limit: int = FETCH_BYTES) -> DataFrame:
    """Texts of the rows (``doc_id``, ``text_hash``) that ``wanted`` lists, with its other columns.

    ``wanted`` must be stored. It is broadcast only if counting shows that it fits; otherwise both sides are shuffled.
    ``docs`` has ``doc_id`` and ``text``; rows that repeat give repeated results.
    """
    given = wanted.withColumnsRenamed({"doc_id": "_llm_id", "text_hash": "_llm_hash"})
    side = F.broadcast(given) if fits_broadcast(given, row_bytes, limit) else given
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (text_hash(F.col("text")) == F.col("_llm_hash"))
    return docs.select("doc_id", "text").join(side, same).drop("_llm_id").withColumnRenamed("_llm_hash", "text_hash")
