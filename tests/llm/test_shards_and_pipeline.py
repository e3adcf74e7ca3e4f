"""Sharding, and the corpus pipeline held against plain versions of its stages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from rasterloom.llm import packing, sharding


def _check(frame, pairs, count=8):
    got = frame.toPandas()
    assert len(got) == len(pairs)
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    ids = [None if np.isnan(i) else int(i) for i in got.doc_id.astype(float)]
    assert sorted(zip(map(repr, ids), got["size"], got.text_crc32)) == want
    assert got.shard.between(0, count - 1).all() and got.grown_shard.isna().all()
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    return got


def test_odd_rows_are_placed(odd):
    pairs, docs = odd
    _check(sharding.shards(docs), pairs)


@pytest.mark.parametrize("hot", [0, 500])
def test_sizes_are_near_equal(documents, prose, hot):
    pairs = prose(n=1500, seed=3) + [(50_000 + i, "the same text again and again, in a third of all rows") for i in range(hot)]
    got = _check(sharding.shards(documents(pairs)), pairs)
    held = got.groupby("shard")["size"].sum()
    assert held.max() - held.min() <= 2 * got["size"].max()
    assert sum(n > 1 for n in got[got.doc_id < 50_000].groupby("text_crc32").shard.nunique()) <= 7


def test_one_text_and_no_text(documents):
    pairs = [(i, "same") for i in range(800)]
    assert sorted(_check(sharding.shards(documents(pairs)), pairs).groupby("shard").size()) == [100] * 8
    assert sharding.shards(documents([])).count() == 0
    _check(sharding.shards(documents([(1, None)])), [(1, None)])


def test_overfull_ranges_are_subdivided(documents, monkeypatch):
    """With a coarse sample ranges differ in size; they are split and nothing else changes."""
    monkeypatch.setattr(sharding, "SAMPLE", 16)
    monkeypatch.setattr(sharding, "OVERFULL", 0.2)
    pairs = [(i, f"text number {i % 300}") for i in range(1200)]
    got = _check(sharding.shards(documents(pairs), 4), pairs, 4)
    held = got.groupby("shard")["size"].sum()
    assert held.max() - held.min() <= 2 * got["size"].max() + 8


# --- pipeline


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):
    """A folder with documents and a benchmark, and their rows."""
    rng = random.Random(12)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    items = [(i, " ".join(r[1].split()[3:18])) for i, r in enumerate(rows[::17])]
    extra = [
        (1001, None, None, None, None), (1002, "", "en", "s", 0), (1003, "12345 !!", "en", "s", 8),
        (1004, f"{rows[5][1]} mail me at some.one@mail.example.com or +1 (555) 123-4567", "en", "s", 1),
        (1005, rows[8][1], "en", "s", 1), (1005, rows[8][1], "en", "s", 1), (None, rows[9][1], "en", "s", 1),
    ]
    rows += extra
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def _by_hand(rows, items):
    """Rows after the four filtering stages."""
    rows = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    low = brute.near_duplicates([(r[0], r[1]) for r in rows], 80)
    rows = [r for r, (doc, _, least) in zip(rows, low) if doc == least]
    hit = brute.contamination([(r[0], r[1]) for r in rows], items)
    rows = [r for r, (_, _, n, _) in zip(rows, hit) if not n]
    clean = [(r[0], brute.sanitised(r[1]), *r[2:4]) for r in rows]
    return sorted(((*r, len(r[1])) for r in clean), key=repr)


def test_stages_against_plain_versions(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs
        seen.append(docs.count())
    assert brute.rows(docs, ["doc_id", "text", "lang", "source", "n_chars"]) == _by_hand(rows, items)
    assert seen[0] > seen[1] > seen[2] > seen[3] == seen[4]


def test_run_packs_what_the_stages_leave(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows, items = corpus
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = corpus_pipeline.run(spark, folder).toPandas()
    want = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in _by_hand(rows, items)}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_clashing_columns_pass_through_the_stages(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    more = {c: F.lit(f"own {c}") for c in ("lang_pred", "score", "n_hit", "items", "base", "spans", "text_hash", "part")}
    docs = docs.withColumns(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    left = docs.collect()
    assert len(left) > 5 and all(r[c] == f"own {c}" for r in left for c in more)


def test_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
