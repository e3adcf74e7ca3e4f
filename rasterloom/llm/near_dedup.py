"""Near-duplicate documents by MinHash signatures, joined through an inverted index of their coordinates.

Documents with equal shingle sets are one class. A class is posted under each (coordinate, value) pair of its
signature. Two signatures that agree in at least T of k coordinates share one of the k - T + 1 rarest pairs of
either (the prefix); longer lists are skipped and only counted when a candidate is compared. Inside a list, classes
are first compared with the list's most central class. Only lists that still hold unlinked classes are looked at
again, and these classes are joined exactly, by the rarest shingles of their full sets. No list is ever paired
with itself before its linked members have been told apart, so a large group of copies costs as many comparisons
as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.arrow import aside, back, slices, tidy, utf8
from rasterloom.llm.components import components
from rasterloom.llm.texts import FETCH_BYTES, fetch, text_hash
from rasterloom.llm.words import SEED, Words, inside, not_blank
from rasterloom.operators.lookup import fits_broadcast
from rasterloom.session import stored

SHINGLE = 5
COORDINATES = 32
PERCENT = 80  # of the union that two sets must share
EARLIER = 64  # shingles before its own that a posting knows of
PARITY = 8  # 64-bit words of parities of a set
MISS = 1e-7  # chance that a link at the very threshold falls below the matches asked for


def least_matches(coordinates: int, share: float, miss: float = MISS) -> int:
    """Coordinates that must agree so that a pair of this similarity is missed with at most the given chance."""
    below, matches = 0.0, 0
    while matches < coordinates:
        below += comb(coordinates, matches) * share**matches * (1 - share) ** (coordinates - matches)
        if below > miss:
            break
        matches += 1
    return max(1, matches)


class Shingler:
    """Shingle sets of the texts of a batch."""

    def __init__(self, size: int):
        self.size, self.words = size, Words(not_blank(), lower=True)

    def hashes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, and where each text's begin (one entry more)."""
        data, offsets = utf8(column)
        starts, ends, first = self.words.split(data, offsets)
        hashed = self.words.hashes(data, starts, ends)
        counts = np.diff(first)
        chosen = inside(first, self.size)
        if len(hashed) >= self.size:
            found = self.words.runs(hashed, self.size)[chosen]
        else:
            found = np.zeros(0, np.uint64)
        row = np.searchsorted(first, chosen, "right") - 1
        for k in range(1, self.size):  # a text of fewer words is one shingle
            short = np.flatnonzero(counts == k)
            if len(short):
                found = np.r_[found, self.words.runs(hashed, k)[first[short]]]
                row = np.r_[row, short]
        if len(row) and np.any(row[1:] < row[:-1]):
            order = np.argsort(row, kind="stable")
            found, row = found[order], row[order]
        return found, np.searchsorted(row, np.arange(len(counts) + 1))

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        found, at = self.hashes(column)
        return [np.unique(found[a:z]) for a, z in zip(at[:-1], at[1:])]


def _digests(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """Per row: number of shingles, a 128-bit key of the set (null if empty), the signature."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        factors = np.random.default_rng(SEED + 1).integers(1, 1 << 63, coordinates, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for part in slices(batch, "text"):
                found, at = shingler.hashes(part.column("text"))
                sets = [np.unique(found[a:z]) for a, z in zip(at[:-1], at[1:])]
                full = np.flatnonzero(np.diff(at))
                signs = np.zeros((len(sets), coordinates), np.int32)
                for i, factor in enumerate(factors if len(full) else []):
                    lowest = np.minimum.reduceat(found * factor, at[:-1][full])
                    signs[full, i] = (lowest >> np.uint64(32)).astype(np.uint32).view(np.int32)
                keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates), pa.array(signs.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists],
                    names=["doc_id", "text_hash", "n_shingles", "set_key", "signature"],
                )
        tidy()

    given = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return given.mapInArrow(digest, "doc_id long, text_hash long, n_shingles long, set_key binary, signature array<int>")


def _postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """Prefix of every signature: its rarest pairs that others share, with the class's centrality."""
    pairs = F.transform("signature", lambda v, i: F.shiftleft(v.cast("long"), 6).bitwiseOR(i.cast("long")))
    posted = classes.select("class", F.explode(pairs).alias("pair"))
    # a table of its own, so that Spark can split the rows of a hot pair in the join
    shared = stored(posted.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    own = posted.join(shared, "pair").groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("lists"), F.sum(F.log2("n")).alias("central")
    )
    # pairs of one class only come first in the order of rarity and take their places in the prefix
    room = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("lists"))
    return own.where(room > 0).select("class", "central", F.explode(F.slice("lists", F.lit(1), room)).alias("list")).select(
        F.col("list.pair").alias("pair"), "class", "central"
    )


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough and whose full sets are similar."""
    left = texts.select(F.col("class").alias("a"), F.col("text").alias("ta"), F.col("signature").alias("sa"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("tb"), F.col("signature").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "sa", "sb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for part in slices(batch, "ta"):
                for half in slices(part, "tb"):
                    n = half.num_rows
                    sa, sb = (half.column(c).flatten().to_numpy().reshape(n, -1) for c in ("sa", "sb"))
                    half = half.filter(pa.array((sa == sb).sum(1) >= matches))
                    ok = []
                    for x, y in zip(shingler.sets(half.column("ta")), shingler.sets(half.column("tb"))):
                        common = len(x) + len(y) - len(np.union1d(x, y))
                        ok.append(100 * common >= percent * (len(x) + len(y) - common))
                    yield half.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        tidy()

    return both.mapInArrow(confirm, "a long, b long")


def _exact_candidates(members: DataFrame, texts: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of classes with different roots that share one of the rarest shingles either must share with a similar set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingler.sets(part.column("text"))
                counts = [len(s) for s in found]
                # parity of the shingles that fall on each bit; bits that differ are shingles that are not common
                odd = [np.packbits(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY) & 1).view(np.int64) for s in found]
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat.view(np.int64)))
                bits = np.stack(odd).T if odd else np.zeros((PARITY, 0), np.int64)
                arrays = [part.column("class"), pa.array(counts, pa.int64()), lists, *(pa.array(b) for b in bits)]
                yield pa.RecordBatch.from_arrays(arrays, names=["class", "n", "shingles", *parity])
        tidy()

    parity = [f"p{k}" for k in range(PARITY)]
    schema = "class long, n long, shingles array<long>, " + ", ".join(f"{p} long" for p in parity)
    chosen = stored(texts.join(members, "class", "left_semi").select("class", "text").mapInArrow(sets, schema))
    each = chosen.select("class", "n", F.explode("shingles").alias("shingle"))
    shared = stored(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    own = each.join(shared, "shingle").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("lists"))
    # Shingles are in the order of rarity, those of one class only first. Of two similar sets of n >= m shingles the
    # first common one leaves room behind it, in both, for all they must share: percent / (100 + percent) of n + m.
    # That is at least percent / 100 of n, and 2 percent / (100 + percent) of m, which bounds its place in either.
    alone = F.col("n") - F.size("lists")
    step = log(100 / percent) * (1 + 1e-9) or 1.0  # similar sets are of one span of sizes or of neighbouring ones
    reach = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    own = own.where(reach > alone).select("class", "n", alone.alias("alone"), F.slice("lists.shingle", F.lit(1), (reach - alone).cast("int")).alias("prefix"))
    listed = own.select("class", "n", "alone", "prefix", F.posexplode("prefix").alias("i", "shingle"))
    listed = listed.join(roots, F.col("class") == F.col("node"), "left").select(
        "shingle",
        "class",
        "n",
        (F.col("n") - F.col("alone") - F.col("i")).alias("left"),
        F.coalesce("root", "class").alias("root"),
        F.slice("prefix", F.greatest(F.col("i") - EARLIER, F.lit(0)) + 1, F.least(F.col("i"), F.lit(EARLIER))).alias("earlier"),
        F.floor(F.log("n") / step).cast("int").alias("span"),
    )
    listed = listed.join(chosen.select("class", *parity), "class")
    listed = stored(listed)
    mixed = listed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    listed = listed.join(mixed, "shingle", "left_semi")
    share = f"({percent} * {{}} + {99 + percent}) div {100 + percent}"  # rounded up
    smaller = listed.select(
        "shingle", F.explode(F.array("span", F.col("span") + 1)).alias("span"), F.col("class").alias("b"), F.col("n").alias("m"), F.col("left").alias("rest"), F.col("root").alias("s"), F.col("earlier").alias("before"),
        *(F.col(p).alias(f"o{p}") for p in parity),
    ).where(F.col("rest") >= F.expr(share.format("2 * m")))
    fits = (F.col("root") != F.col("s")) & ((F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("b") < F.col("class")))
    common = F.expr(share.format("(n + m)"))
    # sets of n and m shingles of which d are not common share (n + m - d) / 2
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"o{p}"))) for p in parity), F.lit(0))
    fits = fits & (F.least("left", "rest") >= common) & (F.col("n") + F.col("m") - apart >= 2 * common)
    # A pair is made at its first common shingle, and again only where none of the last ``EARLIER`` is common too; what
    # a posting holds is bounded, however long its text is.
    fits = fits & ~F.arrays_overlap("earlier", "before")
    pairs = listed.join(smaller, ["shingle", "span"]).where(fits)
    return pairs.select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``.

    Words are runs without blanks, A-Z lower-cased; a text of fewer words than a shingle is one shingle. Sets are
    linked when they share ``percent`` of their union; ``component_id`` is the smallest id reachable over links. A
    text without words, or null, has an empty set and is linked with nothing. A row with a null id has the
    smallest id of its component, or null. Equal rows are linked like any equal texts.
    """
    return _grouped(docs, size, percent, coordinates, doc_id, text).drop("root")


def _grouped(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows of :func:`near_duplicates` with ``root``, the number of their component; null where the set is empty."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    matches = least_matches(coordinates, percent / 100)
    rows = stored(_digests(docs, size, coordinates))
    named = rows.where(F.col("set_key").isNotNull())
    classes = named.groupBy("set_key", "signature").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("row")
    )
    classes = stored(
        classes.select(
            F.monotonically_increasing_id().alias("class"), "set_key", "signature", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash")
        )
    )

    postings = stored(_postings(classes, coordinates, matches))
    hubs = postings.groupBy("pair").agg(F.max(F.struct("central", "class")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spokes = postings.join(stored(hubs.select("pair", F.col("hub.class").alias("hub"))), "pair").where("class <> hub")
    pairs = stored(spokes.select(F.greatest("class", "hub").alias("a"), F.least("class", "hub").alias("b")).distinct())
    involved = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = stored(classes.join(involved, "class", "left_semi").select("doc_id", "text_hash", "class", "signature"))
    texts = stored(fetch(docs, wanted, 40 + 4 * coordinates).dropDuplicates(["class"]).select("class", "signature", "text"))
    links = stored(_linked(pairs, texts, size, percent, matches))
    roots = components(links)

    rooted = postings.join(roots, F.col("class") == F.col("node"), "left").select("pair", "class", F.coalesce("root", "class").alias("root"))
    mixed = rooted.groupBy("pair").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("pair")
    members = stored(postings.join(mixed, "pair", "left_semi").select("class").distinct())
    more = stored(_exact_candidates(members, texts, roots, size, percent))
    further = stored(_linked(more, texts, size, percent, 0))
    if not further.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(further))

    labelled = classes.join(roots, F.col("class") == F.col("node"), "left").select("set_key", "doc_id", F.coalesce("root", "class").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labelled = labelled.join(smallest, "root").select("set_key", "component_id", "root")
    empty = rows.where(F.col("set_key").isNull()).select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")
    )
    return named.select("doc_id", "text_hash", "n_shingles", "set_key").join(labelled, "set_key").drop("set_key").unionByName(empty)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns; rows without words are in no group and are kept.

    It is the row of the smallest id (null last), then of the smallest text hash; of several rows of one id and text the
    first by its other columns.
    """
    docs, own = aside(docs)
    doc_id, text, names = own[doc_id], own[text], docs.columns
    found = _grouped(docs, doc_id=doc_id, text=text, **options).where(F.col("root").isNotNull())
    alike = stored(found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("first"))
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # rows that go, and chosen ones of which there are several
    listed = alike.join(first, "root").where(~chosen | (F.col("n") > 1))
    listed = stored(listed.select(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash"), chosen.alias("_llm_several")))
    several = listed.where("_llm_several")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_llm_id")) & (text_hash(body) == F.col("_llm_hash"))

    def side(given: DataFrame) -> DataFrame:
        return F.broadcast(given) if fits_broadcast(given, 32, FETCH_BYTES) else given

    kept = docs.join(side(listed), same, "left_anti").select(*names)
    if several.isEmpty():
        return back(kept, own)
    order = F.to_json(F.struct(*(F.col(c) for c in names if c != text), F.lit(0).alias("_llm_0")))
    one = docs.join(side(several), same).groupBy("_llm_id", "_llm_hash").agg(F.min_by(F.struct(*names), order).alias("row"))
    return back(kept.unionByName(one.select("row.*")), own)
