"""Document fingerprints from a randomised edit embedding.

A walk reads a text character by character: at step j it notes the character under its pointer and, as a random
function of (j, character) shared by all texts tells it, stays or moves on. Two texts that differ by few edits
are read in step again soon after each edit, so the edit distance shows as Hamming distance of the notes. The
fingerprint samples the notes: of the steps from 2^m to 2^(m+1) a fixed number for every m, as one hex digit each,
so that it grows with the logarithm of the text. Bands of digits find candidates; comparing all digits confirms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.arrow import ddl, extended, slices, without

# fixed values: samples in each doubling of the steps; multipliers of the shared random functions
PER_OCTAVE = 64
MOVE_SEED = 0x9E3779B97F4A7C15
NOTE_SEED = 0xC2B2AE3D27D4EB4F

BLOCK_CHARS = 4 << 20  # characters that walk together
HELD_CHARS = 24 << 20  # characters of a partition that are held at once


def _random(seed: int, start: int, n: int) -> np.ndarray:
    """Random odd 32-bit numbers of the indices from ``start`` on."""
    x = (np.arange(start, start + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(seed)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def sampled_steps(octave: int) -> np.ndarray:
    """The steps of [2^octave, 2^(octave+1)) that are noted: all of a short octave, else one of each stratum."""
    first = 1 << octave
    if first <= PER_OCTAVE:
        return np.arange(first, 2 * first)
    width = first // PER_OCTAVE
    return first + np.arange(PER_OCTAVE) * width + _random(NOTE_SEED, first, PER_OCTAVE).astype(np.int64) % width


def _codes(text: str) -> np.ndarray:
    """A nonzero 32-bit code per character, and a zero at the end."""
    x = np.frombuffer((text + "\0").encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x |= np.uint32(1)
    x[-1] = 0
    return x


def _walk(texts: list[str]) -> list[str]:
    """Fingerprints of texts of about one length, walking together."""
    codes = [_codes(t) for t in texts]
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes)
    at = np.cumsum(sizes) - sizes
    row = np.arange(len(texts))
    digits = np.full((len(texts), 128), 255, np.uint8)
    noted, octave, step, block = 0, 0, 1, 4096
    due = sampled_steps(0)
    due_at = 0
    while True:
        moves = _random(MOVE_SEED, step, block)
        for j in range(block):
            x = flat[at]
            if step == due[due_at]:
                if noted == digits.shape[1]:
                    digits = np.hstack([digits, np.full_like(digits, 255)])
                note = (x * _random(NOTE_SEED, step, 1)[0]) >> np.uint32(28)
                digits[row, noted] = np.where(x, note, 255)
                noted += 1
                due_at += 1
                if due_at == len(due):
                    octave += 1
                    due, due_at = sampled_steps(octave), 0
            x *= moves[j]
            x >>= np.uint32(31)
            at += x
            step += 1
            if not j % 512:
                going = flat[at] != 0
                if not going.any():
                    break
                if going.mean() < 0.8:
                    at, row = at[going], row[going]
        else:
            continue
        break
    ends = (digits[:, :noted] != 255).sum(1)
    return [bytes(d[:n]).translate(_HEX).decode() for d, n in zip(digits, ends)]


_HEX = bytes(b"0123456789abcdef"[i] if i < 16 else 46 for i in range(256))


def fingerprint_all(texts: list[str]) -> list[str]:
    """Fingerprint of every text; texts of like length walk together."""
    out: list[str] = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    block: list[int] = []
    held = 0
    for i in order + [-1]:
        if block and (i < 0 or held + len(texts[i]) > BLOCK_CHARS):
            for k, print_ in zip(block, _walk([texts[k] for k in block])):
                out[k] = print_
            block, held = [], 0
        if i >= 0 and texts[i]:
            block.append(i)
            held += len(texts[i])
    return out


def weights(n: int) -> np.ndarray:
    """How many steps each of the first ``n`` digits stands for."""
    out: list[int] = []
    octave = 0
    while len(out) < n:
        first = 1 << octave
        out += [1] * first if first <= PER_OCTAVE else [first // PER_OCTAVE] * PER_OCTAVE
        octave += 1
    return np.array(out[:n], np.float64)


def likeness(a: str, b: str) -> float:
    """Estimated share of steps at which both walks note the same, less what chance gives; 1 for equal prints."""
    if a == b:
        return 1.0
    n, common = max(len(a), len(b)), min(len(a), len(b))
    same = np.frombuffer(a.encode(), np.uint8)[:common] == np.frombuffer(b.encode(), np.uint8)[:common]
    weight = weights(n)
    share = float(weight[:common][same].sum() / weight.sum())
    return max(0.0, (share - 1 / 16) * 16 / 15)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of the whole text (null: empty, whose fingerprint is empty), replacing column ``name``.

    Equal texts have equal fingerprints; a text's fingerprint depends on nothing else.
    """
    kept = without(docs, [name])
    given = kept.withColumn("_llm_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    schema, names = pa.schema([(name, pa.string())]), kept.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_llm_text", HELD_CHARS):
                prints = fingerprint_all(part.column("_llm_text").to_pylist())
                yield extended(part.select(names), schema, {name: pa.array(prints)})

    return given.mapInArrow(make, ddl(kept, f"{name} string"))


def similar(prints: DataFrame, least: float = 0.7, bands: int = 16, width: int = 6, fingerprint: str = "fingerprint") -> DataFrame:
    """Similar fingerprints by banding: rows (fingerprint, other, likeness), each at least ``least`` alike.

    Distinct fingerprints are banded by ``width`` digits, sampled from the last octave both walks have passed, under
    ``bands`` different samplings. In a bucket every fingerprint is compared with the smallest one only, so a bucket
    of n gives n - 1 comparisons; equal texts share their fingerprint and are not compared at all.
    """
    distinct = prints.select(F.col(fingerprint).alias("fingerprint")).where("length(fingerprint) > 0").distinct()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(MOVE_SEED)
        picks = rng.random((bands, width))
        for batch in batches:
            keys, rows = [], []
            for row, value in enumerate(batch.column("fingerprint").to_pylist()):
                ends = [127 + PER_OCTAVE * k for k in range(64) if 127 + PER_OCTAVE * k <= len(value)]
                # the octave before the last complete one too: a text's end may fall into either
                for end in {ends[-1] if ends else 0, ends[-2] if len(ends) > 1 else 0} - {0} or {min(63, len(value))}:
                    low = max(0, end - PER_OCTAVE)
                    for band, spots in enumerate(picks):
                        at = low + (spots * (end - low)).astype(int)
                        keys.append(f"{end}:{band}:" + "".join(value[i] for i in at))
                        rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("fingerprint").take(pa.array(rows, pa.int64()))], names=["band", "fingerprint"])

    posted = distinct.mapInArrow(post, "band string, fingerprint string")
    first = posted.groupBy("band").agg(F.min("fingerprint").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = posted.join(first, "band").where("fingerprint <> other").select("fingerprint", "other").distinct()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("fingerprint").to_pylist(), batch.column("other").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(likeness, a, b), pa.float64())], names=["fingerprint", "other", "likeness"])

    return pairs.mapInArrow(confirm, "fingerprint string, other string, likeness double").where(F.col("likeness") >= least)


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document.

    Documents are in ascending order of their id (null first), then of their text; after the last comes the first.
    They are dealt to partitions by quantiles of the id, one shuffle of the texts; the first text of each part is
    also sent to the part before it. A task holds a bounded number of characters, or one document and its next.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    cuts = np.unique(np.array(docs.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        place = np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(known, place, 0).astype(np.int32))

    dealt = docs.withColumn("part", part("doc_id"))
    # one id per part, so as many rows as there are partitions; in the order of the parts, null before all ids
    heads = docs.select("doc_id").distinct().withColumn("part", part("doc_id"))
    heads = heads.groupBy("part").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("none"))
    order = sorted(heads.collect(), key=lambda r: r["part"])
    links = [(r["part"], None if r["none"] else r["head"], order[i - 1]["part"]) for i, r in enumerate(order)]
    first = (
        docs.join(F.broadcast(spark.createDataFrame(links, "part int, head long, before int")), F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("before")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("part"), F.lit(True).alias("tail"))
    )
    rows = dealt.withColumn("tail", F.lit(False)).unionByName(first)
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), "text")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text").mapInArrow(_neighbours, out)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, the last one being the first text of the next part; compares each text with the one after it."""
    ids: list[int | None] = []
    texts: list[str] = []
    held = 0

    def compare() -> pa.RecordBatch:
        edited = []
        for text, after in zip(texts, texts[1:]):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        prints = fingerprint_all(texts + edited)
        own, changed = prints[: len(texts)], prints[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(own[:-1], pa.string()),
                pa.array(changed, pa.string()),
                pa.array(map(likeness, own, changed), pa.float64()),
                pa.array(map(likeness, own, own[1:]), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for part in slices(batch, "text"):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held > HELD_CHARS and len(texts) > 1:
                    yield compare()
                    ids, texts, held = ids[-1:], texts[-1:], len(text)
    if len(texts) > 1:
        yield compare()
