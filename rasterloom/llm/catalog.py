"""The registered queries of the training-data operators; each returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rasterloom.llm import collocations, decontaminate, fingerprint, hard_negatives, html_text, language, near_dedup, packing, pii, secret_scan, sharding, substring_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# fixed values: the rules to judge by
URL_RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")
PHRASES_PER_LANGUAGE = 2000


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


@_query
def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(_pages(spark, sf).select("page_id", "url", "html")).drop("html")


@_query
def op2_sampled_splitters(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf))


@_query
def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    marked = decontaminate.contamination(_documents(spark, sf).select("doc_id", "text"), benchmark)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query
def op4_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dedup.near_duplicates(_documents(spark, sf), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@_query
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.digest(_documents(spark, sf))


@_query
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text", "lang")
    labelled = language.identify(docs.select("doc_id", "text"), language.fit(docs)).drop("text")
    return labelled.withColumn("held_out", language.held_out(F.col("doc_id")))


@_query
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    rows = pii.all_spans(_documents(spark, sf).select("doc_id", "text"), keep_text=False)

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(pii.spelled(F.col("base")).cast("binary"), 256)
    return rows.select("doc_id", *map(number, pii.KINDS), digest.alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


@_query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.edited_neighbours(_documents(spark, sf))


@_query
def op9_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules(URL_RULES)).drop("url")


@_query
def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.pieces(_documents(spark, sf)))


@_query
def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    found = collocations.collocations(_documents(spark, sf).select("lang", "text"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PHRASES_PER_LANGUAGE)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@_query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label"))


@_query
def op13_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    rows = secret_scan.scan(_documents(spark, sf).select("doc_id", "text"), keep_text=False)

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(pii.spelled(F.col("base")).cast("binary"), 256)
    spelled = pii.spelled(F.col("spans")).alias("spans")
    return rows.select("doc_id", *map(number, secret_scan.KINDS), digest.alias("base_sha256"), spelled, "n_novel")
