"""Removal of benchmark passages from training documents by their word n-grams.

Windows of the benchmark become a hash set that is broadcast in blocks of bounded size. Every document is scanned
once per block: all its word windows are hashed, looked up, and hits are confirmed word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.arrow import aside, back, ddl, extended, slices, tidy, utf8, with_text, without
from rasterloom.llm.words import Words, alphanumeric, covered, inside, per_text
from rasterloom.session import stored

WINDOW = 10  # fixed value: words of a window
BLOCK_BYTES = 32 << 20
ADDED = "n_words long, n_hit long, items array<string>, hits array<struct<start:long,stop:long>>"


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words lower-cased and joined by blanks."""
    return b" ".join(data[s:e].tobytes().lower() for s, e in zip(starts, ends))


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of every item: hash, number of words, the words, the item. A short item is one window."""
    taken = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("_llm_text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alphanumeric(), lower=True)
        for batch in batches:
            for part in slices(batch, "_llm_text"):
                data, offsets = utf8(part.column("_llm_text"))
                starts, ends, first = words.split(data, offsets)
                hashes = words.hashes(data, starts, ends)
                counts = np.diff(first)
                for k in (size, *sorted({int(n) for n in counts if 0 < n < size})):
                    chosen = inside(first, k)
                    row = np.searchsorted(first, chosen, "right") - 1
                    if k < size:
                        keep = counts[row] == k
                        chosen, row = chosen[keep], row[keep]
                    key = words.runs(hashes, k)[chosen] if len(chosen) else np.zeros(0, np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)), pa.array(np.full(len(key), k, np.int32)),
                            pa.array([_folded(data, starts[i : i + k], ends[i : i + k]) for i in chosen], pa.binary()),
                            part.column("item").take(pa.array(row)),
                        ],
                        names=["key", "size", "gram", "item"],
                    )

    found = taken.mapInArrow(grams, "key long, size int, gram binary, item string")
    return found.distinct()


class Grams:
    """One block of benchmark windows, sorted by hash; equal hashes of different words stay apart."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(table["size"].to_pylist(), table["key"].to_pylist(), table["gram"].to_pylist(), table["item"].to_pylist()), key=lambda r: (r[:3], r[3] or ""))
        self.sizes: dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[str]]]]]] = {}
        for size in sorted({r[0] for r in rows}):
            grams: dict[int, dict[bytes, list[str]]] = {}
            for _, key, gram, item in (r for r in rows if r[0] == size):
                grams.setdefault(key, {}).setdefault(gram, []).extend([item] if item is not None else [])
            keys = np.array(list(grams), np.int64).view(np.uint64)
            order = np.argsort(keys)
            self.sizes[size] = keys[order], [list(list(grams.values())[i].items()) for i in order]


def scan(docs: DataFrame, block: Grams, text: str = "text", start_over: bool = True) -> DataFrame:
    """Mark the words of every document that lie in a window of the block; adds to earlier marks if any."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)
    kept = without(docs, ADDED) if start_over else docs
    names = kept.columns if start_over else [c for c in kept.columns if c not in ("n_words", "n_hit", "items", "hits")]
    given, body = with_text(kept, text)
    schema = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alphanumeric(), lower=True)
        sizes = shared.value.sizes
        # a first look at 20 bits of the hash rejects nearly all windows
        bits = {k: np.zeros(1 << 20, bool) for k in sizes}
        for k, (keys, _) in sizes.items():
            bits[k][keys & np.uint64((1 << 20) - 1)] = True
        for batch in batches:
            for part in slices(batch, body):
                data, offsets = utf8(part.column(body))
                starts, ends, first = words.split(data, offsets)
                hashes = words.hashes(data, starts, ends)
                flags = np.zeros(len(starts), bool)
                items: list[set[str]] = [set() for _ in range(part.num_rows)]
                if not start_over:
                    items = [set(x) for x in part.column("items").to_pylist()]
                    for row, spans in enumerate(part.column("hits").to_pylist()):
                        for span in spans:
                            flags[first[row] + span["start"] : first[row] + span["stop"]] = True
                for k, (keys, grams) in sizes.items():
                    runs = words.runs(hashes, k)
                    maybe = np.flatnonzero(bits[k][runs & np.uint64((1 << 20) - 1)])
                    at = np.minimum(np.searchsorted(keys, runs[maybe]), len(keys) - 1)
                    maybe, at = maybe[keys[at] == runs[maybe]], at[keys[at] == runs[maybe]]
                    row = np.searchsorted(first, maybe, "right") - 1
                    fits = maybe + k <= first[row + 1]
                    hits = []
                    for i, g, r in zip(maybe[fits], at[fits], row[fits]):
                        spelled = _folded(data, starts[i : i + k], ends[i : i + k])
                        for gram, owners in grams[g]:
                            if gram == spelled:
                                hits.append(i)
                                items[r].update(owners)
                    flags |= covered(len(flags), np.array(hits, np.int64), k)
                edge = np.zeros(len(flags) + 1, bool)
                edge[first] = True
                begin = np.flatnonzero(flags & (~np.r_[False, flags[:-1]] | edge[:-1]))
                stop = np.flatnonzero(flags & (~np.r_[flags[1:], False] | edge[1:])) + 1
                base = first[np.searchsorted(first, begin, "right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - base)], names=["start", "stop"])
                yield extended(
                    part.select(names), schema,
                    {
                        "n_words": pa.array(np.diff(first)), "n_hit": pa.array(per_text(flags, first)),
                        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        "hits": pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, first).astype(np.int32)), spans),
                    },
                )
        tidy()

    return given.mapInArrow(mark, ddl(kept.select(*names), ADDED))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Add to every document its words, the words hit, the items (sorted as strings) and the spans hit.

    ``n_words``, ``n_hit``, ``items`` and ``hits`` (runs of words, end exclusive) replace columns of these names.
    A null text has no words. A benchmark item without words has no window; one without an id marks words but is
    not listed. Items of one id count once. The windows are counted first; a benchmark beyond ``block_bytes``
    is taken in several blocks, each a pass over the documents.
    """
    grams = stored(windows(benchmark, size, item, item_text))
    held = grams.agg(F.sum(F.length("gram") + F.coalesce(F.length("item"), F.lit(0)) + F.lit(200))).first()[0] or 0
    blocks = max(1, -(-held // block_bytes))
    out = docs
    for k in range(blocks):
        block = Grams(grams.where(F.pmod("key", F.lit(blocks)) == k).toArrow())
        out = scan(stored(out) if k else out, block, text, start_over=not k)
    return out


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns, whatever their names."""
    given, own = aside(docs)
    marked = contamination(given, benchmark, text=own[text], **options)
    return back(marked.where(F.col("n_hit") == 0), own)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; the words hit are cut out of the text, from the first byte of a run to its last."""
    given, own = aside(docs)
    marked = contamination(given, benchmark, text=own[text], **options)
    names, body = list(own.values()), own[text]
    schema = marked.select(*names).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alphanumeric(), lower=True)
        for batch in batches:
            for part in slices(batch, body):
                data, offsets = utf8(part.column(body))
                starts, ends, first = words.split(data, offsets)
                values = part.column(body).to_pylist()
                for row, spans in enumerate(part.column("hits").to_pylist()):
                    if spans:
                        left, at = [], offsets[row]
                        for span in spans:
                            left.append(data[at : starts[first[row] + span["start"]]].tobytes())
                            at = ends[first[row] + span["stop"] - 1]
                        values[row] = b"".join([*left, data[at : offsets[row + 1]].tobytes()]).decode()
                rows = part.select(names)
                yield rows.set_column(names.index(body), body, pa.array(values, part.column(body).type))

    return back(marked.mapInArrow(cut, schema), own)
