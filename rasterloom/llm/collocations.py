"""Phrase collocations by direct-address tiling.

Words of every language are ranked by frequency; a pair of neighbours is a cell of a (rank, rank) plane. The plane is cut
into square tiles. A tile that many pairs of a buffer fall into is counted densely, by ``bincount`` over its cells; the
pairs of the others are sorted and counted as coordinates. Pairs that reach the least count are ranked again and take the
place of words: runs of three and four words are cells (pair, word) and (pair, pair) of the next plane, those of five to
eight words of the one after. Every plane is one pass over the texts.

Ranks of at most ``HEAD`` units of a length are broadcast, and a bit table of fixed size tells which other units are
frequent. Units beyond the head are counted under the words' own 63-bit codes, so nothing is left out however large the
vocabulary is. Codes are proven to be different for different words; if two words ever met, another seed is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.arrow import slices, tidy, utf8
from rasterloom.llm.words import SEED, Words, mix
from rasterloom.session import stored

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
COVERED = 80  # percent of a phrase's occurrences inside one longer candidate that make it redundant
UNLABELLED = "und"

HEAD = 1 << 20  # units of a length whose ranks are broadcast
TILE = 10  # bits of a rank inside a tile
DENSE = 1 << 16  # pairs of a buffer from which a tile is counted densely
TILES_AT_ONCE = 4
BUFFER = 1 << 21  # pairs that a task counts at once
ROWS_OUT = 1 << 16  # of a batch that a task hands on
FILTER_BITS = 27  # the bit table has 2^27 bits
WORDS_AT_ONCE = 500_000  # words that a task holds before it hands them on
CODE = np.uint64((1 << 63) - 1)

# fixed values: what ends a piece, and what parts words
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"


def _word_bytes() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(BREAKS + BLANKS)] = False
    return table


class Pieces:
    """Words of texts as codes of (language, word), and which of them follow each other inside a piece."""

    def __init__(self, seed: int):
        self.words = Words(_word_bytes(), lower=True, seed=seed)
        self.check = Words(_word_bytes(), lower=True, seed=seed + 1)
        self.breaks = np.zeros(256, bool)
        self.breaks[list(BREAKS)] = True
        self.langs: dict[str, int] = {}

    def _lang(self, name: str) -> int:
        if name not in self.langs:
            self.langs[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        return self.langs[name]

    def split(self, part: pa.RecordBatch):
        """(data, starts, ends, row of each word, code of each word, whether the next word is its neighbour)."""
        data, offsets = utf8(part.column("text"))
        starts, ends, first = self.words.split(data, offsets)
        row = np.repeat(np.arange(part.num_rows), np.diff(first))
        langs = np.array([self._lang(x) for x in part.column("lang").to_pylist()], np.uint64)
        codes = mix(self.words.hashes(data, starts, ends) ^ langs[row]) & CODE
        broken = np.cumsum(self.breaks[data], dtype=np.int64)
        follows = np.zeros(len(starts), bool)
        if len(starts):
            follows[:-1] = (row[1:] == row[:-1]) & (broken[starts[1:]] == broken[ends[:-1] - 1])
        return data, starts, ends, row, codes, follows


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased words at these places."""
    size = ends - starts
    edges = np.r_[0, np.cumsum(size)]
    taken = _FOLD[data[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], size)]]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(taken))


def _summed(rows: list[pa.Table]) -> pa.Table:
    """One row per word; rows of one code stay apart if their second hashes or words differ."""
    return pa.concat_tables(rows).group_by(["code", "second", "lang", "word"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "second", "lang", "word", "n"])


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """(code, lang, word, n) of all words of ``docs`` (lang, text); counted in tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(seed)
        held: list[pa.Table] = []
        fresh = 0  # rows since they were summed

        def words(part: pa.RecordBatch) -> pa.Table:
            data, starts, ends, row, codes, _ = pieces.split(part)
            second = pieces.check.hashes(data, starts, ends)
            unique, at, inverse, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
            # words of one code and another second hash go out under their own names, and are found by the check
            other = np.flatnonzero(second[at][inverse] != second)
            at, n = np.r_[at, other], np.r_[n, np.ones(len(other), np.int64)]
            columns = [codes[at].view(np.int64), second[at], part.column("lang").take(pa.array(row[at])), _spelled(data, starts[at], ends[at]), n]
            return pa.table(columns, names=["code", "second", "lang", "word", "n"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for batch in table.select(["code", "lang", "word", "n"]).cast(schema).to_batches(ROWS_OUT):
                yield batch

        schema = pa.schema([("code", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(words(part))
                fresh += held[-1].num_rows
                if fresh > WORDS_AT_ONCE:
                    held, fresh = [_summed(held)], 0
                    if held[0].num_rows > WORDS_AT_ONCE:
                        yield from out(held.pop())
        if held:
            yield from out(_summed(held))
        held.clear()
        tidy()

    counted = docs.mapInArrow(count, "code long, lang string, word string, n long")
    return counted.repartition("code").groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


class Ranks:
    """Ranks of different keys, found by the keys' leading bits."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.rank = order.astype(np.int32)
        self.keys = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = min(max(len(keys) * 2, 2).bit_length(), 22)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.bincount((keys >> self.shift).astype(np.int64), minlength=1).max(initial=0)) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key, -1 of an unknown one."""
        if len(self.rank) == 0:
            return np.full(len(keys), -1, np.int64)
        at = self.first[(keys >> self.shift).astype(np.int64)]
        for _ in range(self.steps):
            at = at + ((self.keys[at] < keys) & (at < len(self.rank)))
        known = (at < len(self.rank)) & (self.keys[at] == keys)
        return np.where(known, self.rank[np.minimum(at, len(self.rank) - 1)], -1).astype(np.int64)


def _pair_code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def _run_key(ids: list[np.ndarray]) -> np.ndarray:
    """A hash of word ids in a row, for the bit table."""
    key = np.zeros(len(ids[0]), np.uint64)
    for part in ids:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part.view(np.uint64))
    return key


def _bit(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Level:
    """Frequent units of one length: ranks of the head, their (left rank, word rank), and the bits of all if some are beyond."""

    ranks: Ranks
    codes: np.ndarray
    bits: np.ndarray | None = None

    def maybe(self, key: np.ndarray) -> np.ndarray:
        bit = _bit(key)
        return (self.bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def left_size(size: int) -> int:
    """Words of the left part of a unit: the largest power of two below its size."""
    return 1 << ((size - 1).bit_length() - 1)


@dataclass
class Levels:
    """What tasks know of the frequent units of 1 to ``size`` words."""

    seed: int
    known: dict[int, Level] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(self.known)

    def word_ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank or -1, id, whether frequent); words beyond the head go by minus their code, less one."""
        level = self.known[1]
        rank = level.ranks.find(mix(codes))
        own = -1 - codes.view(np.int64)
        ids = np.where(rank >= 0, rank, own)
        frequent = rank >= 0
        if level.bits is not None:
            frequent = frequent | level.maybe(_run_key([own]))
        return rank, ids, frequent

    def paired(self, size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the units that are made of two ranked parts; -1 if either part or the unit has none."""
        out = np.full(len(left), -1, np.int64)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        out[both] = self.known[size].ranks.find(mix(_pair_code(left[both], right[both])))
        return out

    def rank(self, ids: list[np.ndarray]) -> np.ndarray:
        """Rank of units given by their word ids."""
        if len(ids) == 1:
            return np.maximum(ids[0], -1)
        left = left_size(len(ids))
        return self.paired(len(ids), self.rank(ids[:left]), self.rank(ids[left:]))

    def members(self, rank: np.ndarray, size: int) -> list[np.ndarray]:
        """Word ranks of units of a size, by their ranks."""
        if size == 1:
            return [rank.astype(np.int64)]
        codes = self.known[size].codes[rank]
        left = left_size(size)
        return self.members((codes >> np.uint64(32)).astype(np.int64), left) + self.members((codes & np.uint64(0xFFFFFFFF)).astype(np.int64), size - left)


def _shifted(values: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full(len(values), fill, values.dtype)
    out[: len(values) - by] = values[by:]
    return out


def _occurrences(levels: Levels, codes: np.ndarray, follows: np.ndarray, longest: int):
    """Runs longer than the known units, up to twice as long, all of whose parts of that length may be frequent.

    Per length: left rank and right rank where both parts are in the head, and the word ids of the other runs.
    """
    word, ids, frequent = levels.word_ids(codes)
    rank, inside, size = {1: word}, {1: np.ones(len(codes), bool)}, levels.size
    for m in range(2, longest + 1):  # the run of m words stays in a piece
        inside[m] = inside[m - 1] & _shifted(follows, m - 2, False)
    for m in range(2, size + 1):
        left = left_size(m)
        found = levels.paired(m, np.where(inside[m], rank[left], -1), _shifted(rank[m - left], left, -1))
        now = found >= 0
        if levels.known[m].bits is not None:
            tried = np.flatnonzero(inside[m] & ~now & frequent & _shifted(frequent, 1, False))
            tried = tried[levels.known[m].maybe(_run_key([ids[tried + j] for j in range(m)]))]
            now[tried] = True
        rank[m], frequent = found, now
    wanted = frequent
    for m in range(size + 1, longest + 1):
        wanted = wanted & _shifted(frequent, m - size, False) & inside[m]
        right = _shifted(rank[m - size], size, -1)
        head = wanted & (rank[size] >= 0) & (right >= 0)
        rest = np.flatnonzero(wanted & ~head)
        yield m, rank[size][head].astype(np.int32), right[head].astype(np.int32), [ids[rest + j] for j in range(m)]


def tile_counts(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, count) of the pairs: dense tiles by ``bincount`` of their cells, the rest as sorted coordinates."""
    if not len(left):
        return
    across = (int(right.max()) >> TILE) + 1
    tile = (left.astype(np.int64) >> TILE) * across + (right >> TILE)
    filled = np.bincount(tile)
    dense = np.flatnonzero(filled >= DENSE)
    place = np.full(len(filled), -1, np.int32)
    place[dense] = np.arange(len(dense))
    slot = place[tile]
    low = (1 << TILE) - 1
    for at in range(0, len(dense), TILES_AT_ONCE):
        here = np.flatnonzero((slot >= at) & (slot < at + TILES_AT_ONCE))
        cell = ((slot[here] - at).astype(np.int64) << 2 * TILE) | ((left[here] & low).astype(np.int64) << TILE) | (right[here] & low)
        n = np.bincount(cell)
        cell = np.flatnonzero(n)
        owner = dense[at + (cell >> 2 * TILE)]
        yield (owner // across << TILE) | (cell >> TILE & low), (owner % across << TILE) | (cell & low), n[cell]
    sparse = slot < 0
    if sparse.any():
        codes = _pair_code(left[sparse], right[sparse])
        codes.sort()
        edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        n = np.diff(np.r_[edges, len(codes)])
        codes = codes[edges]
        yield (codes >> np.uint64(32)).astype(np.int64), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64), n


def coordinate_counts(ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different runs of word ids and their counts, by sorting."""
    order = np.lexsort(ids[::-1])
    ids = [part[order] for part in ids]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [part[1:] != part[:-1] for part in ids])
    edges = np.flatnonzero(new)
    return [part[edges] for part in ids], np.diff(np.r_[edges, len(order)])


def _names(size: int) -> list[str]:
    return [f"w{i}" for i in range(1, size + 1)]


def count_longer(docs: DataFrame, levels: Levels, least: int, longest: int) -> DataFrame:
    """(w1, w2, ..., n) of the runs that are longer than the known units, up to twice as long and ``longest`` words, and
    occur ``least`` times or more; stored. The last words of shorter runs are null."""
    size = levels.size
    longest = min(longest, 2 * size)
    names = _names(longest)
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    schema = pa.schema([(x, pa.int64()) for x in [*names, "n"]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        pieces = Pieces(levels.seed)
        held: dict[int, tuple[list, list, list]] = {m: ([], [], []) for m in range(size + 1, longest + 1)}
        number = 0

        def rows(ids: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            gaps = [pa.nulls(len(n), pa.int64())] * (longest - len(ids))
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in ids), *gaps, pa.array(n.astype(np.int64))], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            for m, (lefts, rights, others) in held.items():
                left, right = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (lefts, rights))
                lefts.clear(), rights.clear()
                for left, right, n in tile_counts(left, right):
                    for i in range(0, len(n), ROWS_OUT):
                        part = slice(i, i + ROWS_OUT)
                        yield rows(levels.members(left[part], size) + levels.members(right[part], m - size), n[part])
                if others:
                    ids, n = coordinate_counts([np.concatenate(x) for x in zip(*others)])
                    others.clear()
                    for i in range(0, len(n), ROWS_OUT):
                        yield rows([x[i : i + ROWS_OUT] for x in ids], n[i : i + ROWS_OUT])

        for batch in batches:
            for part in slices(batch, "text"):
                codes, follows = pieces.split(part)[4:]
                for m, left, right, rest in _occurrences(levels, codes, follows, longest):
                    held[m][0].append(left)
                    held[m][1].append(right)
                    if len(rest[0]):
                        held[m][2].append(rest)
                    number += len(left) + len(rest[0])
                if number > BUFFER:
                    yield from flush()
                    number = 0
        yield from flush()
        tidy()

    counted = docs.mapInArrow(count, ", ".join(f"{x} long" for x in [*names, "n"]))
    found = stored(counted.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    shared.destroy()
    return found


def _bits(units: DataFrame, names: list[str]) -> np.ndarray:
    """The bit table of all units: a fixed number of bits, or-ed by Spark."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(_run_key([batch.column(x).to_numpy() for x in names]))
            value = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(value)], names=["slot", "value"])

    found = units.select(*names).mapInArrow(bits, "slot long, value long").groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[found["slot"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return table


def _head(units: DataFrame, head: int) -> tuple[DataFrame, bool]:
    """The most frequent units, ``head`` at most, and whether these are all; cut at a count, not by sorting."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    grades = sorted(((r["grade"], r["units"]) for r in units.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("units")).collect()), reverse=True)
    total, cut = 0, None
    for number, held in grades:
        if total + held > head:
            return (units.where(grade >= cut) if cut is not None else units.limit(0)), False
        total, cut = total + held, number
    return units, True


def _word_level(words: DataFrame, head: int) -> Level:
    top, whole = _head(words, head)
    rows = top.select("code", "n").toArrow()
    codes = rows["code"].to_numpy().view(np.uint64)
    codes = codes[np.lexsort((codes, -rows["n"].to_numpy()))]
    own = words.select((-1 - F.col("code")).alias("w1"))
    return Level(Ranks(mix(codes)), codes, None if whole else _bits(own, ["w1"]))


def _unit_level(units: DataFrame, levels: Levels, size: int, head: int) -> Level:
    """Re-rank the frequent units of a size: those whose two parts have ranks themselves."""
    names = _names(size)
    top, whole = _head(units, head)
    rows = top.select(*names, "n").toArrow()
    ids = [rows[x].to_numpy() for x in names]
    part = left_size(size)
    left, right = levels.rank(ids[:part]), levels.rank(ids[part:])
    in_head = np.flatnonzero((left >= 0) & (right >= 0))
    codes = _pair_code(left[in_head], right[in_head])
    codes = codes[np.lexsort((codes, -rows["n"].to_numpy()[in_head]))]
    whole = whole and len(in_head) == len(left)
    return Level(Ranks(mix(codes)), codes, None if whole else _bits(units, names))


def _with_ids(words: DataFrame, levels: Levels) -> DataFrame:
    """(w1, lang, word, n) of the frequent words; stored."""
    shared = words.sparkSession.sparkContext.broadcast(levels)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ids, _ = shared.value.word_ids(batch.column("code").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(batch.column(x) for x in ("lang", "word", "n"))], names=["w1", "lang", "word", "n"])

    named = stored(words.select("code", "lang", "word", "n").mapInArrow(name, "w1 long, lang string, word string, n long"))
    shared.destroy()
    return named


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, head: int = HEAD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (w1, lang, word, n), frequent runs (ids, n) of 1 to ``longest`` words, and words in all (lang, n)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNLABELLED)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    seed = SEED
    while True:
        every = stored(vocabulary(rows, seed))
        if every.repartition("code").groupBy("code").count().where("count > 1").isEmpty():
            break
        seed += 2
    totals = stored(every.groupBy("lang").agg(F.sum("n").alias("n")))
    words = stored(every.where(F.col("n") >= least))
    levels = Levels(seed, {1: _word_level(words, head)})
    named = _with_ids(words, levels)
    runs = [named.select(F.array("w1").alias("ids"), "n")]
    while levels.size < longest:
        size, most = levels.size, min(2 * levels.size, longest)
        counted = count_longer(rows, levels, least, most)
        runs.append(counted.select(F.filter(F.array(*_names(most)), lambda w: w.isNotNull()).alias("ids"), "n"))
        if most == longest:
            break
        for m in range(size + 1, most + 1):
            units = counted.where(F.col(f"w{m}").isNotNull())
            units = units if m == most else units.where(F.col(f"w{m + 1}").isNull())
            levels = Levels(seed, {**levels.known, m: _unit_level(units, levels, m, head)})
    return named, reduce(DataFrame.unionByName, runs), totals


def _whole(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, head: int = HEAD
) -> DataFrame:
    """Phrases of 2 to ``longest`` words with their scores: (lang, phrase, a, l, r, n, score).

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, n all words of the language; the score is
    2,000,000 a / (l + r), rounded down. A phrase inside a longer candidate that has ``covered`` percent of its
    occurrences is left out. Null texts are empty, a null language is ``und``, repeated rows count each; an empty table
    or one without frequent phrases gives no rows. Other columns of the table are not looked at.
    """
    words, runs, totals = phrase_counts(docs, text, lang, least, longest, head)
    size = F.size("ids")
    runs = stored(runs)
    candidates = runs.where(size > 1)
    cuts = candidates.select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(runs.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first")
    cuts = cuts.join(runs.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
    # products may pass 64 bits; the quotient never does
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    weakest = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m)))))
    inner = candidates.where(size > 2).select(F.col("n").alias("longer"), part.alias("ids")).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = weakest.join(inner, "ids", "left").where(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * covered))

    spelled = kept.select("ids", "a", "cut", F.posexplode("ids").alias("at", "w1")).join(words.select("w1", "lang", "word"), "w1")
    spelled = spelled.groupBy("ids", "a", "cut").agg(
        F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    return spelled.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
