"""A corpus pipeline over ``documents``: language, near-duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and
read again as the next one's documents. All but the last keep the columns of the documents. Rows with nulls, empty
texts, repeated rows and further columns go through as the operators say; an empty table gives an empty result.
Stages lower the session's number of rows per Arrow batch, as :func:`in_small_batches` says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import decontaminate, language, near_dedup, packing, pii
from rasterloom.llm.arrow import aside, back
from rasterloom.session import stored

LEAST_SCORE = 0.5
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 500  # of a batch that goes to Python: whole documents, so that a few megabytes are on the way at a time


def in_small_batches(spark: SparkSession) -> None:
    """From now on this session hands Python at most ``ROWS`` rows at once; a lower setting stays as it is."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language: those without letters, or as likely in another language, go."""
    in_small_batches(spark)
    model = language.fit(docs)
    given, own = aside(docs)  # the operator replaces columns of its names
    labelled = language.identify(given, model, text=own["text"])
    return back(labelled.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), own)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    in_small_batches(spark)
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    in_small_batches(spark)
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences."""
    in_small_batches(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language ID", identified),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", sanitised),
    ("best-fit packing", packed),
]

# tokenisation and the learned model are beyond SQL; tests hold the result against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
