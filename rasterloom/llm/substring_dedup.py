"""Removal of passages that repeat across documents, by fixed-block anchors.

A window is 50 words. Of any window, wherever it lies, one of its document's non-overlapping blocks of 25 words lies
inside. So the blocks of all documents are the index, every rolling run of 25 words is a probe, and a probe that
meets a block of a smaller document is an anchor. Anchors are extended by the 25 words around them: the windows over
an anchor, on both sides, are compared as wholes, and the windows that an earlier document holds too, joined
together, are the maximal repeats.

Two exact shortcuts come first. Documents equal word for word are judged by their first one. And a document
takes part only where it can: of the 26 runs of 25 words in a window the one with the smallest hash is the same
wherever the window occurs, so a window whose smallest run occurs in one document only has no repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.arrow import slices, utf8
from rasterloom.llm.texts import fetch, text_hash
from rasterloom.llm.words import Words, covered, inside, not_blank
from rasterloom.session import stored

WINDOW = 50  # words


class Runs:
    """Words of a batch of texts, the hashes of their blocks, and each window's smallest run."""

    def __init__(self, window: int):
        self.window, self.block = window, window // 2
        self.words = Words(not_blank(), lower=False)

    def read(self, column: pa.Array) -> None:
        data, offsets = utf8(column)
        starts, ends, self.first = self.words.split(data, offsets)
        self.hashes = self.words.hashes(data, starts, ends)
        self.starts = inside(self.first, self.window)  # first words of all windows
        self.row = np.searchsorted(self.first, self.starts, "right") - 1

    def blocks(self) -> np.ndarray:
        return self.words.runs(self.hashes, self.block)

    def smallest(self) -> np.ndarray:
        """For every window the smallest hash of a block's length of words inside it."""
        low, width = self.blocks(), 1
        runs = self.window - self.block + 1
        if len(low) < runs:
            return np.zeros(0, np.uint64)
        while width < runs:
            step = min(width, runs - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        return low[self.starts]


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Values as one list per row; rows ascend."""
    at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def _digests(docs: DataFrame, window: int) -> DataFrame:
    """Per row: words, a 128-bit key of their sequence, the digest of the words joined, the windows' smallest runs."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(window)
        for batch in batches:
            for part in slices(batch, "text"):
                runs.read(part.column("text"))
                low, rows = runs.smallest(), runs.row
                change = np.ones(len(low), bool)
                change[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
                joined = [b" ".join((t or "").encode().split()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(runs.first)),
                        pa.array([blake2b(t, digest_size=16).digest() for t in joined], pa.binary()),
                        pa.array([sha256(t).digest() for t in joined], pa.binary()),
                        _lists(low[change], rows[change], part.num_rows),
                    ],
                    names=["doc_id", "text_hash", "n_words", "sequence", "digest", "lows"],
                )

    given = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return given.mapInArrow(digest, "doc_id long, text_hash long, n_words long, sequence binary, digest binary, lows array<long>")


def _grams(texts: DataFrame, window: int, aligned: bool) -> DataFrame:
    """Runs of a block's length inside the windows that may repeat: all of them, or the blocks only."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(window)
        for batch in batches:
            for part in slices(batch, "text"):
                runs.read(part.column("text"))
                low, active = runs.smallest(), np.zeros(len(runs.starts), bool)
                bounds = np.searchsorted(runs.row, np.arange(part.num_rows + 1))
                for i, lows in enumerate(part.column("lows").to_pylist()):
                    active[bounds[i] : bounds[i + 1]] = np.isin(low[bounds[i] : bounds[i + 1]], np.array(lows, np.int64).view(np.uint64))
                words = covered(len(runs.hashes), runs.starts[active], window - runs.block + 1)
                at = np.flatnonzero(words)  # first words of runs inside an active window
                row = np.searchsorted(runs.first, at, "right") - 1
                place = at - runs.first[row]
                if aligned:
                    keep = place % runs.block == 0
                    at, row, place = at[keep], row[keep], place[keep]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((runs.blocks()[at] if len(at) else np.zeros(0, np.uint64)).view(np.int64)), part.column("doc_id").take(pick), part.column("doc").take(pick), pa.array(place.astype(np.int32))],
                    names=["key", "doc_id", "doc", "place"],
                )

    return texts.select("doc_id", "doc", "text", "lows").mapInArrow(find, "key long, doc_id long, doc long, place int")


def _windows(anchored: DataFrame, window: int) -> DataFrame:
    """Hash, document and place of every window over an anchor."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(window)
        for batch in batches:
            for part in slices(batch, "text"):
                runs.read(part.column("text"))
                hits = part.column("places")
                owner = np.repeat(np.arange(part.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
                anchor = hits.flatten().to_numpy() + runs.first[owner]
                reach = window - runs.block
                # a window over an anchor begins at most ``reach`` words before it; none begins before its text
                wanted = covered(len(runs.hashes) + reach + 1, anchor, reach + 1)[reach:][runs.starts]
                at, row = runs.starts[wanted], runs.row[wanted]
                pick = pa.array(row)
                keys = runs.words.runs(runs.hashes, window)[at] if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), part.column("doc_id").take(pick), part.column("doc").take(pick), pa.array((at - runs.first[row]).astype(np.int32))],
                    names=["key", "doc_id", "doc", "place"],
                )

    return anchored.select("doc_id", "doc", "text", "places").mapInArrow(extend, "key long, doc_id long, doc long, place int")


def _cut(repeated: DataFrame, window: int) -> DataFrame:
    """What is left of texts whose windows at ``places`` are removed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                removed, left = [], []
                for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist()):
                    words = text.encode().split()
                    gone = covered(len(words), np.array(places, np.int64), window)
                    removed.append(int(gone.sum()))
                    left.append(b" ".join(w for w, g in zip(words, gone) if not g).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(removed, pa.int64()), pa.array(left, pa.string())],
                    names=["doc_id", "text_hash", "n_removed", "kept"],
                )

    return repeated.select("doc_id", "text_hash", "text", "places").mapInArrow(cut, "doc_id long, text_hash long, n_removed long, kept string")


class Repeats:
    """Result of :func:`repeats`: ``rows`` has all rows with ``n_words``, ``copied`` and ``digest`` (sha256 of the
    words joined by blanks); ``cut`` has what is left of the texts that lost some words but are no whole copies."""

    def __init__(self, rows: DataFrame, cut: DataFrame):
        self.rows, self.cut = rows, cut


def repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> Repeats:
    """Find the words covered by a window that also starts in a document with a smaller id.

    Words are runs without blanks, taken as they are; a null text has none. ``window`` is even. Rows with one id are no
    source for each other. A null id counts as larger than all others, so that such a row is no source for any with an
    id. Nothing is judged on what is left after a removal.
    """
    if window < 2 or window % 2:
        raise ValueError("a window has an even number of words")
    last = (1 << 63) - 1
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(last)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = stored(_digests(docs, window))
    long = rows.where(F.col("n_words") >= window)
    owners = long.groupBy("sequence").agg(F.min("doc_id").alias("owner"))
    own = long.join(owners, "sequence").where(F.col("doc_id") == F.col("owner")).select("doc_id", "text_hash", "lows").distinct()

    posted = own.select("doc_id", "text_hash", F.explode("lows").alias("low"))
    shared = posted.groupBy("low").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("low")
    active = stored(posted.join(shared, "low").groupBy("doc_id", "text_hash").agg(F.collect_set("low").alias("lows")))
    # a document's rows of one text are one; rows of one id but different texts are documents of their own
    texts = fetch(docs, active, 400).dropDuplicates(["doc_id", "text_hash"])
    texts = stored(texts.withColumn("doc", F.monotonically_increasing_id()))

    index = _grams(texts, window, aligned=True)
    index = stored(index)
    smallest = index.groupBy("key").agg(F.min("doc_id").alias("source"))
    hits = stored(_grams(texts, window, aligned=False).join(smallest, "key").where(F.col("source") < F.col("doc_id")).select("key", "doc", "place"))
    met = index.join(hits.select("key").distinct(), "key", "left_semi").select("doc", "place")
    anchors = hits.select("doc", "place").union(met).groupBy("doc").agg(F.collect_set("place").alias("places"))
    found = stored(_windows(texts.join(anchors, "doc"), window))
    first = found.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("key", "source")
    gone = found.join(first, "key").where(F.col("source") < F.col("doc_id")).groupBy("doc").agg(F.collect_list("place").alias("places"))
    cut = _cut(texts.join(gone, "doc"), window)

    copied = F.coalesce((F.col("n_words") >= window) & (F.col("owner") < F.col("doc_id")), F.lit(False))
    judged = rows.drop("lows").join(owners, "sequence", "left").select(
        "doc_id", "text_hash", "n_words", "digest", copied.alias("copied")
    )
    return Repeats(judged, stored(cut))


def digest(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of the words left, joined by one space."""
    found = repeats(docs, window, doc_id, text)
    cut = found.cut.select("doc_id", "text_hash", F.col("n_removed").alias("gone"), F.sha2(F.col("kept").cast("binary"), 256).alias("left"))
    rows = found.rows.join(cut, ["doc_id", "text_hash"], "left")
    removed = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0)))
    kept = F.when(F.col("copied"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left", F.lower(F.hex("digest"))))
    return rows.select(F.nullif("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with the repeated words cut out of the text; a text that loses nothing stays as it is, byte for byte."""
    names = docs.columns
    found = repeats(docs, window, doc_id, text)
    changed = found.rows.where("copied").select("doc_id", "text_hash", F.lit("").alias("_llm_left")).distinct()
    changed = changed.unionByName(found.cut.select("doc_id", "text_hash", F.col("kept").alias("_llm_left")))
    changed = changed.withColumnsRenamed({"doc_id": "_llm_id", "text_hash": "_llm_hash"})
    last = F.lit((1 << 63) - 1)
    same = (F.coalesce(F.col(doc_id).cast("long"), last) == F.col("_llm_id")) & (text_hash(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("_llm_hash"))
    joined = docs.join(changed, same, "left")
    return joined.withColumn(text, F.coalesce("_llm_left", F.col(text))).select(*names)
