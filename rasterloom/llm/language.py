"""Language identification by known words first, with back-off to character n-grams.

The model holds word counts per language for the commonest words, and counts of character n-grams of those words'
sample. A known word adds its log frequency in each language; an unseen word is scored by its n-grams of the longest
size of which any is known. The model is fitted on a bounded, documented sample of labelled rows and has a bounded
number of entries, which bounds its broadcast. Languages take turns in naming entries, the commonest first, and every
entry has the counts of all languages.

Entries are 64-bit hashes in sorted arrays. Tasks look up all words of some megabytes of text at once, and the n-grams
of the unseen ones; nothing is remembered from one batch to the next.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.llm.arrow import ddl, extended, slices, tidy, with_text, without
from rasterloom.llm.words import BYTE_STEP, mix

UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 4000  # expected labelled rows per language that the model is fitted on
WORD_ENTRIES = 200_000  # over all languages
GRAM_ENTRIES = 200_000
SIZES = (4, 3, 2, 1)  # of the n-grams, longest first
CERTAIN_WORDS = 20  # words after which more text no longer sharpens the score

WORD = r"[^\W\d_]+"


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not learn from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _grams(word: str, size: int) -> list[str]:
    padded = f"\x02{word}\x03" if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = re.compile(WORD)
    counts: dict[str, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"]
            )
        counts.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                found = words.findall((text or "").lower())
                counts.setdefault(lang, Counter()).update(found)
                held += len(found)
            if held > 2_000_000:
                yield from flush()
                held = 0
    yield from flush()
    tidy()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for size in SIZES:
                for gram in _grams(word, size):
                    counts[lang, gram] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "gram", "n"],
        )


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are word characters, and which are letters; made once per worker."""
    every = "".join(map(chr, range(0x110000)))
    word = np.zeros(0x110000, bool)
    for run in re.finditer(WORD, every):
        word[run.start() : run.end()] = True
    return word, np.fromiter(map(str.isalpha, every), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the code points of every run."""
    step, n = np.uint64(BYTE_STEP), len(points) + 1
    power = np.full(n, step)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n, np.uint64(pow(BYTE_STEP, -1, 1 << 64)))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(n, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _hashes(texts: list[str]) -> np.ndarray:
    """Hash of every text as a whole."""
    edges = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return _run_hashes(_points("".join(texts)), edges[:-1], edges[1:])


def _table(langs: list[str], rows: pa.Table, key: str, totals: dict[tuple[str, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the entries, sorted, and their log frequency in each language, half a count added.

    ``totals`` by language and length (words: 0).
    """
    coded = rows[key].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    counts = np.zeros((len(names), len(langs)), np.float32)
    counts[coded.indices.to_numpy(), np.searchsorted(np.array(langs), rows["lang"].to_pylist()) if len(rows) else []] = rows["n"].to_numpy()
    length = np.array([len(w) if key == "gram" else 0 for w in names], np.int64)
    lengths = range(length.max(initial=0) + 1)
    size = np.array([[totals.get((x, n), 0) for x in langs] for n in lengths], np.float32).reshape(len(lengths), len(langs))
    keys = _hashes(names)
    order = np.argsort(keys)
    return keys[order], (np.log(counts + 0.5) - np.log(size[length] + 0.5 * (len(names) + 1)))[order]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Languages, and per word and n-gram a row of log frequencies; at most the documented entries."""

    def __init__(self, langs: list[str], words: pa.Table, grams: pa.Table, word_totals: dict, gram_totals: dict):
        self.langs = langs
        self.words, self.word_rows = _table(langs, words, "word", word_totals)
        self.grams, self.gram_rows = _table(langs, grams, "gram", gram_totals)

    def rows(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of the different words among these runs, and which of them each run is."""
        unique, first, which = np.unique(_run_hashes(points, starts, ends), return_index=True, return_inverse=True)
        at, known = _find(self.words, unique)
        out = np.zeros((len(unique), len(self.langs)), np.float32)
        out[known] = self.word_rows[at[known]]
        unseen = np.flatnonzero(~known)
        out[unseen] = self._backed_off(points, starts[first[unseen]], ends[first[unseen]])
        return out, which

    def _backed_off(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log frequency of a word's known n-grams of the longest size of which any is known."""
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        size = ends - starts + 2  # with a mark before and behind
        edges = np.r_[0, np.cumsum(size)]
        inner = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
        place = np.repeat(starts, size) + inner - 1
        padded = points[np.clip(place, 0, max(len(points) - 1, 0))] if len(starts) else np.zeros(0, np.uint32)
        padded = np.where(inner == 0, 2, np.where(inner == np.repeat(size, size) - 1, 3, padded))
        open_ = np.ones(len(starts), bool)  # words without any known n-gram yet
        for n in SIZES:
            low, high = (edges[:-1] + 1, edges[1:] - 1) if n == 1 else (edges[:-1], edges[1:])
            room = np.where(open_, np.maximum(high - low - n + 1, 0), 0)
            if not room.sum():
                continue
            word = np.repeat(np.arange(len(starts)), room)
            begin = np.arange(len(word)) - np.repeat(np.cumsum(room) - room, room) + low[word]
            at, known = _find(self.grams, _run_hashes(padded, begin, begin + n))
            word, at = word[known], at[known]
            number = np.bincount(word, minlength=len(starts))
            hit = number > 0
            for lang in range(len(self.langs)):
                total = np.bincount(word, self.gram_rows[at, lang], len(starts))
                out[hit, lang] = total[hit] / number[hit]
            open_ &= ~hit
        return out


def _turns(counted: DataFrame, key: str, most: int) -> pa.Table:
    """Counts in all languages of ``most`` entries at most; languages name their commonest in turn."""
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))  # of the bounded sample
    named = counted.withColumn("turn", turn).orderBy("turn", F.desc("n"), "lang", key).limit(most).select(key).distinct()
    return counted.join(F.broadcast(named), key).select("lang", key, "n").toArrow()


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE
) -> Model:
    """Fit on rows that are not held out, with a label and a text; per language about ``per_language`` of them.

    Which rows is decided by a hash of id and text.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count()
    share = sizes.select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share"))
    lot = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(share), "lang").where(lot < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    try:
        word_totals = {(r["lang"], 0): r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        words = _turns(counted, "word", WORD_ENTRIES)
        grams = counted.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        grams = grams.persist()
        size = F.length("gram").alias("size")
        gram_totals = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", size).agg(F.sum("n").alias("n")).collect()}
        chosen = _turns(grams, "gram", GRAM_ENTRIES)
        grams.unpersist()
    finally:
        counted.unpersist()
    return Model(sorted(lang for lang, _ in word_totals), words, chosen, word_totals, gram_totals)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, replacing columns of these names; only the text is looked at.

    ``und`` with score 0 for a null text, one without letters, and when no language was learned. The score is the
    share of the best language when the mean log frequencies are turned into odds; ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, ["lang_pred", "score"])
    names = kept.columns
    given, body = with_text(kept, text)
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        in_word, letter = _classes()
        for batch in batches:
            for part in slices(batch, body):
                texts = [(value or "").lower() for value in part.column(body).to_pylist()]
                points = _points("\n".join([*texts, ""]))
                edges = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
                word = in_word[points]
                starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
                ends = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
                letters = np.r_[0, np.cumsum(letter[points])]
                row = np.searchsorted(edges, starts, "right") - 1
                number = np.bincount(row, minlength=len(texts))
                rows, which = model.rows(points, starts, ends)
                total = np.zeros((len(texts), max(len(model.langs), 1)))
                for lang in range(len(model.langs)):
                    total[:, lang] = np.bincount(row, rows[which, lang], len(texts))
                top = total.argmax(1)
                mean = total / np.maximum(number, 1)[:, None] * np.minimum(number, CERTAIN_WORDS)[:, None]
                best = 1.0 / np.exp(np.minimum(mean - mean[np.arange(len(texts)), top][:, None], 0)).sum(1)
                seen = (number > 0) & (np.diff(letters[edges]) > 0) & (len(model.langs) > 0)
                langs = np.array([*model.langs, UNKNOWN], object)[np.where(seen, top, -1)]
                yield extended(part.select(names), schema, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.where(seen, best, 0.0))})
        tidy()

    return given.mapInArrow(label, ddl(kept, "lang_pred string, score double"))
