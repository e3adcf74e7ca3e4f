"""Hard negatives by segment summaries.

Vectors are quantised and stored with the mean and the deviation of their segments, at several levels of ever shorter
segments. The product of two vectors lies within ``sum(length * mean * mean) +- sum(deviation * deviation)``; an anchor
needs only rows whose range reaches what it still looks for, so a batch of rows is thinned out level by level and only
the pairs that are left are scored exactly.

Anchors are taken in blocks of bounded bytes, a pass over the rows for each; a task keeps a few rows per anchor, and
these are merged by aggregation. Rows are never gathered by label or anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rasterloom.session import new_folder, stored

FACTOR = 256  # of the quantisation
LEVELS = (1, 4, 16)  # segments of a vector, level by level
POSITIVES = 5
NEGATIVES = 3
LOWEST, HIGHEST = 50, 95  # a negative's score as percent of the positive's
BLOCK_BYTES = 32 << 20  # of anchors broadcast at once
BATCH = 2048  # rows scored at once
PAIRS = 1 << 16  # pairs scored one by one at once
EXACT = 1 << 50  # up to here doubles and their sums are integers without error, with room for the bounds

Matrix = np.ndarray


def segments(vectors: Matrix, parts: int) -> list[Matrix]:
    """The columns in at most ``parts`` segments of nearly equal length."""
    edges = np.linspace(0, vectors.shape[1], min(parts, max(vectors.shape[1], 1)) + 1).astype(int)
    return [vectors[:, a:b] for a, b in zip(edges[:-1], edges[1:])]


def summary(vectors: Matrix, parts: int) -> tuple[Matrix, Matrix]:
    """Mean times the root of the length, and deviation (root of the sum of squares about the mean), per segment."""
    means, deviations = [], []
    for s in segments(vectors.astype(np.float64), parts):
        mean = s.mean(1) if s.shape[1] else np.zeros(len(s))
        means.append(mean * np.sqrt(s.shape[1]))
        deviations.append(np.sqrt(((s - mean[:, None]) ** 2).sum(1)))
    return np.stack(means, 1), np.stack(deviations, 1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None, kind=np.float64) -> Matrix:
    """Lists as rows, zeros behind shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    width = max(int(size.max(initial=0)), width or 0)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).astype(kind)
    out = np.zeros((len(size), width), kind)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def prepare(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", shift_every: int | None = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, q, means, deviations) of the rows that take part.

    Rows with a null id, label or vector, or any null or non-finite component, do not. Where the id is divisible by
    ``shift_every`` the label becomes (label + 1) % ``labels``. A component x becomes floor(256 x) of x as double;
    one beyond 2^31 is refused. ``means`` and ``deviations`` hold the summaries of all levels one after another.
    """
    value = F.col(vector).cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = F.col(label).cast("long")
    if shift_every:
        own = F.when(F.col(vec_id) % shift_every == 0, (own + 1) % labels).otherwise(own)
    taken = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(sound)
    taken = taken.select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("label"), value.alias("vector"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.cumsum(size)].astype(np.int32)
            whole = np.floor(FACTOR * column.flatten().to_numpy(zero_copy_only=False))
            if np.abs(whole).max(initial=0) >= 1 << 31:
                raise ValueError("a component is too large to be quantised to 32 bits")
            flat = whole.astype(np.int32)
            # vectors of one length are summarised together
            parts = [min(p, max(int(n), 1)) for n in size for p in LEVELS]
            at = np.r_[0, np.cumsum(np.array(parts, np.int64).reshape(-1, len(LEVELS)).sum(1))].astype(np.int32)
            means, deviations = np.zeros(at[-1]), np.zeros(at[-1])
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                vectors = flat[edges[rows][:, None] + np.arange(n)]
                both = [summary(vectors, p) for p in LEVELS]
                places = at[rows][:, None] + np.arange(sum(m.shape[1] for m, _ in both))
                means[places] = np.concatenate([m for m, _ in both], 1)
                deviations[places] = np.concatenate([d for _, d in both], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(means)), pa.ListArray.from_arrays(pa.array(at), pa.array(deviations)),
                ],
                names=["vec_id", "label", "q", "means", "deviations"],
            )

    return taken.mapInArrow(summarise, "vec_id long, label long, q array<int>, means array<double>, deviations array<double>")


@dataclass
class Vectors:
    """Vectors of one length with their summaries, as matrices."""

    ids: np.ndarray
    labels: np.ndarray
    q: Matrix
    levels: list[tuple[Matrix, Matrix]]
    norm: np.ndarray  # largest absolute component

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch, width: int) -> Vectors:
        """Rows of a table by :func:`prepare`. Summaries of rows shorter than ``width`` do not line up, and are made anew."""
        q = _matrix(rows.column("q"), width, np.int64)
        size = pc.list_value_length(rows.column("q")).to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, int)
        if rows.num_rows and (size == q.shape[1]).all():
            means, deviations = _matrix(rows.column("means")), _matrix(rows.column("deviations"))
            parts = [min(p, max(q.shape[1], 1)) for p in LEVELS]
            edges = np.r_[0, np.cumsum(parts)]
            levels = [(means[:, a:b], deviations[:, a:b]) for a, b in zip(edges[:-1], edges[1:])]
        else:
            levels = [summary(q, p) for p in LEVELS]
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        return cls(ids, labels, q, levels, np.abs(q).max(1, initial=0))

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors(self.ids[rows], self.labels[rows], self.q[rows], [(m[rows], d[rows]) for m, d in self.levels], self.norm[rows])


def products(rows: Matrix, anchors: Matrix) -> Matrix:
    """Exact integer products; through doubles where these hold every partial sum."""
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)), np.int64)
    largest = int(np.abs(rows).max()) * int(np.abs(anchors).max()) * rows.shape[1]
    if largest < 1 << 53:
        kind = np.float32 if largest < 1 << 24 else np.float64
        return (rows.astype(kind) @ anchors.astype(kind).T).astype(np.int64)
    exact = rows.astype(object) @ anchors.astype(object).T
    if max(abs(int(exact.max())), abs(int(exact.min()))) >= 1 << 63:
        raise OverflowError("a score needs more than 64 bits")
    return exact.astype(np.int64)


def survivors(rows: Vectors, anchors: Vectors, least: np.ndarray, most: np.ndarray, allowed: Matrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the allowed pairs with ``least <= score <= most`` of the anchor.

    Level by level, pairs go whose bounds miss that range, and with them rows and anchors that have no pair left.
    """
    at, to = np.arange(len(rows.ids)), np.arange(len(anchors.ids))
    size = max(int(rows.norm.max(initial=0)) * int(anchors.norm.max(initial=0)) * max(rows.q.shape[1], 1), 1)
    for (mean, deviation), (own_mean, own_deviation) in zip(rows.levels, anchors.levels) if size < EXACT else ():
        middle = mean[at] @ own_mean[to].T
        reach = deviation[at] @ own_deviation[to].T + 0.5  # scores are integers, so rounding errors do no harm
        allowed &= middle + reach >= least[to]
        allowed &= middle - reach <= most[to]
        kept_rows, kept_anchors = allowed.any(1), allowed.any(0)
        at, to, allowed = at[kept_rows], to[kept_anchors], allowed[kept_rows][:, kept_anchors]
        if not allowed.size:
            none = np.zeros(0, np.int64)
            return none, none, none
    if allowed.sum() * 16 < allowed.size:
        r, a = np.nonzero(allowed)
        r, a = at[r], to[a]
        scores = [
            np.einsum("ij,ij->i", rows.q[r[i : i + PAIRS]], anchors.q[a[i : i + PAIRS]]) if size < EXACT
            else np.array([products(rows.q[x : x + 1], anchors.q[y : y + 1])[0, 0] for x, y in zip(r[i : i + PAIRS], a[i : i + PAIRS])], np.int64)
            for i in range(0, len(r), PAIRS)
        ]
        s = np.concatenate([np.zeros(0, np.int64), *scores])
        fits = (s >= least[a]) & (s <= most[a])
        return r[fits], a[fits], s[fits]
    scores = products(rows.q[at], anchors.q[to])
    allowed &= (scores >= least[to]) & (scores <= most[to])
    r, a = np.nonzero(allowed)
    return at[r], to[a], scores[r, a]


class Best:
    """The first ``k`` (score, id) of every slot, scores descending, ids ascending."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k = k
        self.floor = least.astype(np.int64)  # a score below this is of no use any more
        self.slot = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.r_[True, slot[1:] != slot[:-1]]
        start = np.flatnonzero(new)
        place = np.arange(len(slot)) - np.repeat(start, np.diff(np.r_[start, len(slot)]))
        kept = place < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.floor[slot[full]] = score[full]


@dataclass
class Block:
    """A block of anchors; with the scores of their positives, one slot per (anchor, positive)."""

    anchors: Vectors
    slot_anchor: np.ndarray | None = None
    lowest: np.ndarray | None = None
    highest: np.ndarray | None = None


def _pass(prepared: DataFrame, block: Block, k: int, same: bool) -> DataFrame:
    """(slot, vec_id, score): per task the first ``k`` rows of each slot, of the anchor's label or of other labels."""
    spark = prepared.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        anchors = block.anchors
        n, low, high = len(anchors.ids), np.iinfo(np.int64).min, np.iinfo(np.int64).max
        slots = n if same else len(block.slot_anchor)
        best = Best(slots, k, np.full(slots, low) if same else block.lowest)
        first = np.arange(n + 1) if same else np.searchsorted(block.slot_anchor, np.arange(n + 1))
        used = np.flatnonzero(np.diff(first))
        most = np.full(n, high)
        if not same:
            most[used] = np.maximum.reduceat(block.highest, first[used]) if len(used) else 0
        for batch in batches:
            for begin in range(0, batch.num_rows if len(used) else 0, BATCH):
                rows = Vectors.of(batch.slice(begin, BATCH), anchors.q.shape[1])
                least = np.full(n, high)
                least[used] = np.minimum.reduceat(best.floor, first[used])
                if rows.q.shape[1] > anchors.q.shape[1]:  # what lies beyond all anchors adds nothing to a score
                    q = rows.q[:, : anchors.q.shape[1]]
                    rows = Vectors(rows.ids, rows.labels, q, [summary(q, p) for p in LEVELS], np.abs(q).max(1, initial=0))
                if same:  # label by label, so that no pair of two labels is looked at
                    found = []
                    for label in np.intersect1d(rows.labels, anchors.labels):
                        mine, own = np.flatnonzero(rows.labels == label), np.flatnonzero(anchors.labels == label)
                        part, some = rows.take(mine), anchors.take(own)
                        r, a, s = survivors(part, some, least[own], most[own], part.ids[:, None] != some.ids)
                        found.append((mine[r], own[a], s))
                    r, a, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                    best.add(a, s, rows.ids[r])
                    continue
                some = anchors.take(used)
                allowed = (rows.labels[:, None] != some.labels) & (rows.ids[:, None] != some.ids)
                r, a, s = survivors(rows, some, least[used], most[used], allowed)
                a = used[a]
                each = np.diff(first)[a]  # a pair stands in every slot of its anchor whose range it fits
                slot = np.repeat(first[a], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                r, s = np.repeat(r, each), np.repeat(s, each)
                fits = (s >= best.floor[slot]) & (s <= block.highest[slot])
                best.add(slot[fits], s[fits], rows.ids[r[fits]])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], names=["slot", "vec_id", "score"])

    found = prepared.mapInArrow(search, "slot long, vec_id long, score long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchor_every: int = 50,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shift_every: int | None = 7,
    labels: int = 10,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hard negatives of every anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_every``. A positive is one of the first rows of the same label
    by score, a negative one of the first of another label with ``lowest`` to ``highest`` percent of the positive's score;
    ties go to the smaller id. Rows are taken as :func:`prepare` says. A shorter vector counts as filled up with zeros. Rows
    that repeat an id count each, but never for an anchor of the same id; results of repeated anchors repeat. An empty
    table, or anchors without such rows, give no rows. Other columns are not looked at.
    """
    prepared = stored(prepare(rows, vec_id, vector, label, shift_every, labels))
    anchors = prepared.where(F.col("vec_id") % anchor_every == 0)
    # anchors of one id are dealt out by their place, so that a repeated id does not overfill a block
    anchors = stored(anchors.withColumn("lot", F.xxhash64(F.monotonically_increasing_id())))
    size = F.sum(F.size("q") * 8 + F.size("means") * 16 + F.lit(64)).alias("bytes")
    held = anchors.agg(size, F.max(F.size("q")).alias("width")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if held["bytes"] is None:
        return rows.sparkSession.createDataFrame([], schema)
    blocks = -(-held["bytes"] // block_bytes)
    folder = new_folder(rows.sparkSession, "negatives")
    for b in range(blocks):
        table = anchors.where(F.pmod("lot", F.lit(blocks)) == b).drop("lot").toArrow()
        block = Block(Vectors.of(table, held["width"]))
        near = _pass(prepared, block, positives, same=True).orderBy("slot", "rank").toArrow()
        slot, score = near["slot"].to_numpy(), near["score"].to_numpy()
        block = Block(block.anchors, slot, *_limits(score, lowest, highest))
        found = _pass(prepared, block, negatives, same=False)
        known = pa.table({"slot": np.arange(len(slot)), "anchor_id": block.anchors.ids[slot], "positive_id": near["vec_id"].to_numpy(), "positive_score": score})
        pairs = rows.sparkSession.createDataFrame(known)  # positives of one block: a few numbers per anchor
        result = found.select("slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        result.join(F.broadcast(pairs), "slot").drop("slot").write.mode("append").parquet(folder)
    return rows.sparkSession.read.schema(schema).parquet(folder)


def _limits(score: np.ndarray, lowest: int, highest: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest integer score of a negative; products may pass 64 bits."""
    low = [-(-lowest * int(s) // 100) for s in score]
    high = [highest * int(s) // 100 for s in score]
    return np.array(low, np.int64), np.array(high, np.int64)
