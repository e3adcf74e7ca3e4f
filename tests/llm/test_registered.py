"""Every registered query of the operators: against its SQL, or against a plain version."""

import hashlib

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import brute
import check
from rasterloom.llm import catalog, oracles, pii

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return check.tables(sf)


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in NAMES)
    assert numbers == list(range(1, 14))
    assert set(NAMES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(name, spark, sf, con):
    result = catalog.QUERIES[name](spark, sf)
    relation = con.sql(oracles.SQL[name])
    types = {f.name: f.dataType.simpleString() for f in result.schema}
    other = dict(zip(relation.columns, map(str, relation.types)))
    assert all(check._same(types[c], other[c]) for c in types)
    assert check.difference(result.toPandas(), relation.df()) is None


def test_pages(spark, sf):
    got = catalog.QUERIES["op1_html_extraction"](spark, sf).toPandas()
    assert list(got.columns) == ["page_id", "url", "text", "n_chars"]
    assert (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).all()
    assert not got.text.str.contains("track(", regex=False).any()


def test_shards(spark, sf, docs):
    got = catalog.QUERIES["op2_sampled_splitters"](spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    import zlib

    raw = [t.encode() for t in docs.text]
    assert (got["size"].to_numpy() == np.array([len(t) + 1 for t in raw])).all()
    assert (got.text_crc32.to_numpy() == np.array([zlib.crc32(t) for t in raw])).all()
    assert sorted(got.shard.unique()) == list(range(8)) and set(got.law) == {"bytes"}
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    held = got.groupby("shard")["size"].sum()
    assert held.max() - held.min() <= 2 * got["size"].max()


def test_languages(spark, sf, docs):
    got = catalog.QUERIES["op6_language_id"](spark, sf).toPandas().merge(docs[["doc_id", "lang"]])
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_personal_data(spark, sf, docs):
    got = catalog.QUERIES["op7_pii"](spark, sf).toPandas().set_index("doc_id")
    for doc, text in zip(docs.doc_id, docs.text):
        spans = brute.base_spans(text)
        spelled = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got.base_sha256[doc] == brute.sha(spelled) and got.spans[doc].startswith(spelled)
        for kind in pii.KINDS:
            assert got[f"n_{kind}"][doc] == sum(k == kind for k, _, _ in spans)


def test_neighbours(spark, sf, docs):
    got = catalog.QUERIES["op8_fingerprints"](spark, sf).toPandas().set_index("doc_id")
    texts = list(docs.text)
    for doc, text, after in zip(docs.doc_id, texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got.n_chars[doc] == len(text) and got.edited_sha256[doc] == hashlib.sha256(edited.encode()).hexdigest()
    assert (got.near_edited > got.near_next).mean() > 0.97
    assert got.fingerprint.groupby(docs.set_index("doc_id").text).nunique().max() == 1


def test_packing(spark, sf, docs):
    from rasterloom.llm import packing

    got = catalog.QUERIES["op10_best_fit_packing"](spark, sf).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    import zlib

    for doc, text in zip(docs.doc_id, docs.text):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        pieces = got[got.doc_id == doc].sort_values("piece")
        assert list(pieces.piece) == list(range(-(-len(ids) // 1024)))
        assert list(pieces.start) == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.length.iloc[1:] == 1024).all()
        for start, length, crc in zip(pieces.start, pieces.length, pieces.ids_crc32):
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 1
