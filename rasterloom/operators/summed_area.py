"""Box sums of any window by a distributed summed-area table.

The table is never written. Every tile learns the sums above it and to the left of it from two passes over the
tiles, one down each column of tiles and one along each row. The sum in a box is then a few look-ups at its
corners, so a tile is computed from at most 36 parts of other tiles, about four times its own bytes, whatever the
window. Borders mirror without repeating the edge pixel.

A column and a row of tiles of one image are each read by one task, one tile at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.operators.lookup import lookup_join

_KEYS = ["image_id", "ty", "tx"]
_SHAPED = ["image_id", "ty", "tx", "rows", "cols", "height", "width", "planes"]
_DOWN = "image_id BIGINT, ty INT, tx INT, rows INT, cols INT, height INT, width INT, planes BINARY, above BINARY"
_ALONG = _DOWN + ", beside BINARY"
_PART = (
    "image_id BIGINT, ty INT, tx INT, top INT, left INT, rows INT, cols INT, height INT, width INT, own BOOLEAN,"
    " planes BINARY, above BINARY, beside BINARY"
)
_BATCH_BYTES = 1 << 24


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "BOOLEAN": pa.bool_(), "BINARY": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _running(axis: str, tile: int, channels: int, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass down columns of tiles (``ty``) or along rows of them (``tx``); adds the sums before each tile.

    ``above`` holds, per channel, the sums of whole pixel columns over the tile; ``beside`` those of whole pixel rows
    to its left, with the sum over both, of everything above and left of the tile, as its first number.
    """
    down = axis == "ty"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, expected, full, sums = None, 0, True, None
        out: list[tuple] = []
        held = 0
        for row in _rows(batches):
            planes = np.frombuffer(row["planes"], np.uint8).reshape(-1, row["rows"], row["cols"])[:channels]
            here = (row["image_id"], row["tx" if down else "ty"])
            if here != line:
                line, expected, full, sums = here, 0, True, 0
            if row[axis] != expected or not full:
                raise ValueError(f"image {row['image_id']}: missing or repeated pixels around tile {row['ty']}, {row['tx']}")
            expected, full = expected + 1, row["rows" if down else "cols"] == tile
            if down:
                parts = planes.sum(axis=1, dtype=np.int64)
            else:
                above = np.frombuffer(row["above"], np.int64).reshape(channels, -1)
                parts = np.concatenate([above.sum(axis=1)[:, None], planes.sum(axis=2, dtype=np.int64)], axis=1)
            before = np.zeros_like(parts) + sums
            if parts.shape != before.shape:
                raise ValueError(f"image {row['image_id']}: rows of different lengths")
            sums = before + parts
            values = [row[n] for n in _names(schema)[:-1]]
            out.append((*values, before.tobytes()))
            held += len(row["planes"])
            if held > _BATCH_BYTES:
                yield _batch(out, schema)
                out, held = [], 0
        yield _batch(out, schema)

    return run


def _prefix(k: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sum of the mirrored axis before each position, as (factor, place) pairs.

    The sum is the total of factor * P(place), with P(place) the sum of the first ``place`` pixels of the axis itself.
    """
    one = np.ones_like(k)
    if length == 1:
        return [(k, one)]
    period = 2 * (length - 1)
    whole, rest = np.floor_divide(k, period), np.mod(k, period)
    turned = (rest > length).astype(k.dtype)  # the way back from the far border
    return [
        (whole + turned, length * one),
        (whole + turned, (length - 1) * one),
        (-whole, one),
        (1 - 2 * turned, np.where(turned > 0, 2 * length - 1 - rest, rest)),
    ]


class _Axis:
    """The places one tile asks for on an axis, and how the sums in its windows come from them."""

    def __init__(self, length: int, radius: int, tile: int, at: int):
        k = np.arange(at * tile, min(length, (at + 1) * tile), dtype=np.int64)
        terms = _prefix(k + radius + 1, length) + [(-f, p) for f, p in _prefix(k - radius, length)]
        terms = [(np.where(p > 0, f, 0), p) for f, p in terms]
        self.places = np.unique(np.concatenate([p[f != 0] for f, p in terms]))
        self.terms = [(f, np.minimum(np.searchsorted(self.places, p), len(self.places) - 1)) for f, p in terms if f.any()]

    def combine(self, table: np.ndarray) -> np.ndarray:
        """Window sums over the first axis of a table of sums at ``places``."""
        return sum(f[:, None] * table[at] for f, at in self.terms)


@lru_cache(maxsize=4096)
def _axis(length: int, radius: int, tile: int, at: int) -> _Axis:
    return _Axis(length, radius, tile, at)


@lru_cache(maxsize=16)
def _askers(length: int, radius: int, tile: int) -> list[list[tuple[int, int, int]]]:
    """For each tile of an axis, the tiles that ask for pixels low..high-1 of it."""
    tiles = -(-length // tile)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(tiles)]
    for at in range(tiles):
        pixels = _Axis(length, radius, tile, at).places - 1
        for source in np.unique(pixels // tile):
            inside = pixels[pixels // tile == source]
            out[source].append((at, int(inside[0]), int(inside[-1]) + 1))
    return out


def _send(radius: int, tile: int, channels: int, colour: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The parts of each tile that others ask for, with the table's row above and column beside each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for row in _rows(batches):
            image, ty, tx, rows, cols, height, width = (row[n] for n in _SHAPED[:-1])
            planes = np.frombuffer(row["planes"], np.uint8).reshape(-1, rows, cols)
            above = np.frombuffer(row["above"], np.int64).reshape(channels, cols)
            beside = np.frombuffer(row["beside"], np.int64).reshape(channels, rows + 1)
            table = np.zeros((channels, rows + 1, cols + 1), np.int64)
            table[:, 1:, 1:] = planes[:channels].cumsum(axis=1, dtype=np.int64).cumsum(axis=2)
            table[:, :, 1:] += above.cumsum(axis=1)[:, None, :]
            table += np.concatenate([beside[:, :1], beside[:, 1:].cumsum(axis=1) + beside[:, :1]], axis=1)[:, :, None]
            if colour:  # the tile's own bytes, for alpha
                out.append((image, ty, tx, ty * tile, tx * tile, rows, cols, height, width, True, row["planes"], b"", b""))
            for dy, top, bottom in _askers(height, radius, tile)[ty]:
                y, h = top - ty * tile, bottom - top
                for dx, left, right in _askers(width, radius, tile)[tx]:
                    x, w = left - tx * tile, right - left
                    part = planes[:channels, y : y + h, x : x + w].tobytes()
                    over, side = table[:, y, x : x + w + 1].tobytes(), table[:, y : y + h + 1, x].tobytes()
                    out.append((image, dy, dx, top, left, h, w, height, width, False, part, over, side))
                    held += len(part) + len(over) + len(side)
                    if held > _BATCH_BYTES:
                        yield _batch(out, _PART)
                        out, held = [], 0
        yield _batch(out, _PART)

    return run


def _sums(parts: list[dict], down: _Axis, across: _Axis, channels: int) -> np.ndarray:
    table = np.zeros((channels, len(down.places), len(across.places)), np.int64)
    filled = 0
    for p in parts:
        y = np.searchsorted(down.places, [p["top"] + 1, p["top"] + p["rows"] + 1])
        x = np.searchsorted(across.places, [p["left"] + 1, p["left"] + p["cols"] + 1])
        over = np.frombuffer(p["above"], np.int64).reshape(channels, 1, -1)
        side = np.frombuffer(p["beside"], np.int64).reshape(channels, -1, 1)
        inner = np.frombuffer(p["planes"], np.uint8).reshape(channels, p["rows"], p["cols"])
        sums = inner.cumsum(axis=1, dtype=np.int64).cumsum(axis=2) + over[:, :, 1:] + side[:, 1:] - over[:, :, :1]
        at_y, at_x = down.places[slice(*y)] - p["top"] - 1, across.places[slice(*x)] - p["left"] - 1
        table[:, slice(*y), slice(*x)] = sums[:, at_y][:, :, at_x]
        filled += len(at_y) * len(at_x)
    if filled != table[0].size:
        raise ValueError(f"image {parts[0]['image_id']}: missing or repeated pixels around tile {parts[0]['ty']}, {parts[0]['tx']}")
    return np.stack([across.combine(down.combine(t).T).T for t in table])


def box_sums(
    packed: DataFrame, shapes: DataFrame, radius: int, tile: int, channels: int, colour: bool, make: Callable, schema: str
) -> DataFrame:
    """Rows that ``make`` builds from the sums in the (2r+1) x (2r+1) boxes around the pixels of each tile.

    ``packed``: (image_id, ty, tx, rows, cols, planes); ``shapes``: (image_id, height, width), settled now. ``make``
    is given the tile's image, its first row and column, its sums as (channels, rows, cols), and its own bytes if
    ``colour``, and returns a record batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and any(held[0][k] != row[k] for k in _KEYS):
                yield finish(held)
                held = []
            held.append(row)
        if held:
            yield finish(held)

    def finish(parts: list[dict]) -> pa.RecordBatch:
        first = parts[0]
        down = _axis(first["height"], radius, tile, first["ty"])
        across = _axis(first["width"], radius, tile, first["tx"])
        sums = _sums([p for p in parts if not p["own"]], down, across, channels)
        own = next((np.frombuffer(p["planes"], np.uint8).reshape(-1, p["rows"], p["cols"]) for p in parts if p["own"]), None)
        return make(first["image_id"], first["ty"] * tile, first["tx"] * tile, sums, own)

    shaped = lookup_join(packed, shapes.select("image_id", "height", "width"), ["image_id"], "inner").select(*_SHAPED)
    columns = shaped.repartition("image_id", "tx").sortWithinPartitions("image_id", "tx", "ty")
    above = columns.mapInArrow(_running("ty", tile, channels, _DOWN), _DOWN)
    lines = above.repartition("image_id", "ty").sortWithinPartitions("image_id", "ty", "tx")
    beside = lines.mapInArrow(_running("tx", tile, channels, _ALONG), _ALONG)
    parts = beside.mapInArrow(_send(radius, tile, channels, colour), _PART)
    return parts.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, schema)
