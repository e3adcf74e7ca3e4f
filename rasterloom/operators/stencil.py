"""Neighbourhood operators on dense rasters.

Pixels are packed into square tiles, one shuffle of one integer per pixel. A tile then sends its packed bytes to
every tile that they lie near, a second shuffle of about one byte per channel. A task computes one tile at a time
from the bytes around it, with running sums, and holds about (tile + window)^2 bytes per channel. Windows that reach
beyond the next tile are summed by :mod:`summed_area` instead, at a cost that does not depend on the window. Borders
mirror without repeating the edge pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom import fixed_values as fixed
from rasterloom.operators import summed_area
from rasterloom.schema import LEVELS, PIXELS, PIXELS_BGR, image_shapes, is_colour

TILE = 256
_TILE_KEYS = ["image_id", "ty", "tx"]
_PIECE = "image_id BIGINT, ty INT, tx INT, top INT, left INT, rows INT, cols INT, own BOOLEAN, planes BINARY"
_STRIP = 64  # rows whose running sums are made at once


def mirrored(first: int, stop: int, length: int | None) -> np.ndarray:
    """The pixel shown at each position first..stop-1 of an axis.

    Positions beyond the border mirror with period 2 * (length - 1); a single pixel is its own border. Without
    ``length`` no position lies beyond the far border.
    """
    at = np.arange(first, stop)
    if length is None:
        return np.abs(at)
    if length == 1:
        return np.zeros_like(at)
    period = 2 * (length - 1)
    at = np.mod(at, period)
    return np.where(at < length, at, period - at)


def _tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """(image_id, ty, tx, items): place and channels of a tile's pixels, one integer each."""
    if is_colour(pixels):
        alpha = F.col("a") if "a" in pixels.columns else F.lit(None).cast("int")
        # one bit beside the channels says that alpha is missing
        value = ((F.col("b") * LEVELS + F.col("g")) * LEVELS + F.col("r")).cast("long") * LEVELS + F.coalesce(alpha, F.lit(0))
        value = value + F.when(alpha.isNull(), F.lit(1 << 32)).otherwise(F.lit(0).cast("long"))
    else:
        value = F.col("v").cast("long")
    place = (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile))).cast("long")
    rows = pixels.select(
        "image_id",
        F.floor(F.col("y") / tile).cast("int").alias("ty"),
        F.floor(F.col("x") / tile).cast("int").alias("tx"),
        (place * (1 << 33) + value).alias("item"),
    )
    return rows.groupBy(*_TILE_KEYS).agg(F.collect_list("item").alias("items"))


def _planes(items: np.ndarray, tile: int, colour: bool, where: str) -> np.ndarray:
    """Bytes of a tile as (channels, rows, cols); the last of a colour tile's five says that alpha is missing."""
    items = np.sort(items)
    place = items >> 33
    rows, cols = int(place[-1]) // tile + 1, int((place % tile).max()) + 1
    wanted = (np.arange(rows)[:, None] * tile + np.arange(cols)).ravel()
    if not np.array_equal(place, wanted):
        raise ValueError(f"{where}: missing or repeated pixels")
    value = items & ((1 << 33) - 1)
    shifts = (24, 16, 8, 0, 32) if colour else (0,)
    return np.stack([(value >> s).astype(np.uint8) & (1 if s == 32 else 255) for s in shifts]).reshape(-1, rows, cols)


def _packed(tiles: DataFrame, tile: int, colour: bool) -> DataFrame:
    """(image_id, ty, tx, rows, cols, planes): the bytes of every tile."""
    names = ["image_id", "ty", "tx", "rows", "cols", "planes"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (image, ty, tx) in enumerate(zip(*(batch.column(c).to_pylist() for c in _TILE_KEYS))):
                planes = _planes(batch.column("items")[row].values.to_numpy(), tile, colour, f"image {image}, tile {ty}, {tx}")
                out.append((image, ty, tx, *planes.shape[1:], planes.tobytes()))
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.binary()]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return tiles.mapInArrow(pack, "image_id BIGINT, ty INT, tx INT, rows INT, cols INT, planes BINARY")


def _near(tiles: DataFrame, radius: int, tile: int, colour: bool) -> DataFrame:
    """Every tile's own bytes, and the parts of them that lie within ``radius`` of another tile."""
    reach = -(-radius // tile)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in _TILE_KEYS]
            out = []
            for row, (image, ty, tx) in enumerate(zip(*keys)):
                planes = _planes(batch.column("items")[row].values.to_numpy(), tile, colour, f"image {image}, tile {ty}, {tx}")
                _, rows, cols = planes.shape
                # a tile that is not full is the last one of its axis
                down = range(max(0, ty - reach), ty + 1 + (reach if rows == tile else 0))
                across = range(max(0, tx - reach), tx + 1 + (reach if cols == tile else 0))
                for dy in down:
                    low, high = max(0, (dy * tile - radius) - ty * tile), min(rows, (dy + 1) * tile + radius - ty * tile)
                    for dx in across:
                        first, stop = max(0, (dx * tile - radius) - tx * tile), min(cols, (dx + 1) * tile + radius - tx * tile)
                        if low < high and first < stop:
                            part = planes[:, low:high, first:stop]
                            out.append((image, dy, dx, ty * tile + low, tx * tile + first, high - low, stop - first, (dy, dx) == (ty, tx), part.tobytes()))
                if sum(len(r[-1]) for r in out) > 1 << 24:
                    yield _pieces(out)
                    out = []
            yield _pieces(out)

    return tiles.mapInArrow(send, _PIECE)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * 9
    names = ["image_id", "ty", "tx", "top", "left", "rows", "cols", "own", "planes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class _Tile:
    """One tile and what lies around it: ``view`` gives any rectangle of positions, mirrored at the borders."""

    def __init__(self, pieces: list[dict], radius: int, tile: int, channels: int):
        own = next(p for p in pieces if p["own"])
        self.top, self.left, self.rows, self.cols = own["top"], own["left"], own["rows"], own["cols"]
        self.y0, self.x0 = min(p["top"] for p in pieces), min(p["left"] for p in pieces)
        bottom, right = max(p["top"] + p["rows"] for p in pieces), max(p["left"] + p["cols"] for p in pieces)
        self.bytes = np.zeros((channels, bottom - self.y0, right - self.x0), np.uint8)
        if sum(p["rows"] * p["cols"] for p in pieces) != self.bytes[0].size:
            raise ValueError(f"image {own['image_id']}: missing or repeated pixels around tile {own['ty']}, {own['tx']}")
        for p in pieces:
            y, x = p["top"] - self.y0, p["left"] - self.x0
            self.bytes[:, y : y + p["rows"], x : x + p["cols"]] = np.frombuffer(p["planes"], np.uint8).reshape(channels, p["rows"], p["cols"])
        # if less came than the window reaches, the image ends there
        self.height = bottom if bottom < self.top + tile + radius else None
        self.width = right if right < self.left + tile + radius else None

    def down(self, before: int, after: int) -> np.ndarray:
        return mirrored(self.top - before, self.top + self.rows + after, self.height) - self.y0

    def across(self, before: int, after: int) -> np.ndarray:
        return mirrored(self.left - before, self.left + self.cols + after, self.width) - self.x0

    def own(self, channel: int) -> np.ndarray:
        y, x = self.top - self.y0, self.left - self.x0
        return self.bytes[channel, y : y + self.rows, x : x + self.cols]

    def box_sums(self, channel: int, radius: int) -> np.ndarray:
        """Sum over the (2r+1) x (2r+1) neighbourhood of each own pixel."""
        source, x = self.bytes[channel], self.across(radius, radius)
        lines = np.empty((len(source), self.cols), np.int64)
        for at in range(0, len(source), _STRIP):
            running = np.cumsum(source[at : at + _STRIP][:, x], axis=1, dtype=np.int64)
            lines[at : at + _STRIP] = running[:, 2 * radius :]
            lines[at : at + _STRIP, 1:] -= running[:, : self.cols - 1]
        running = np.cumsum(lines[self.down(radius, radius)], axis=0)
        sums = running[2 * radius :].copy()
        sums[1:] -= running[: self.rows - 1]
        return sums


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Pieces of one tile after the other; rows come sorted by tile."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and tuple(held[0][k] for k in _TILE_KEYS) != tuple(row[k] for k in _TILE_KEYS):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _neighbourhoods(pixels: DataFrame, radius: int, tile: int, compute: Callable[[_Tile], list[np.ndarray]]) -> DataFrame:
    """New channels of every pixel, computed tile by tile; alpha is carried over."""
    colour = is_colour(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _grouped(batches):
            if not any(p["own"] for p in pieces):  # beyond the image
                continue
            part = _Tile(pieces, radius, tile, 5 if colour else 1)
            yield _pixel_rows(pieces[0]["image_id"], part.top, part.left, compute(part), (part.own(3), part.own(4)) if colour else None)

    pieces = _near(_tiles(pixels, tile), radius, tile, colour)
    placed = pieces.repartition(*_TILE_KEYS).sortWithinPartitions(*_TILE_KEYS)
    return _with_given_alpha(placed.mapInArrow(run, PIXELS_BGR if colour else PIXELS), pixels)


def _pixel_rows(image: int, top: int, left: int, channels: list[np.ndarray], alpha: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """Rows of a tile's pixels; ``alpha`` holds its values and where they are missing."""
    rows, cols = channels[0].shape
    y, x = np.mgrid[top : top + rows, left : left + cols]
    columns = [np.full(y.size, image, np.int64), *(c.ravel().astype(np.int32) for c in (y, x, *channels))]
    arrays = [pa.array(c) for c in columns]
    if alpha is not None:
        arrays.append(pa.array(alpha[0].ravel().astype(np.int32), mask=alpha[1].ravel().astype(bool)))
    return pa.RecordBatch.from_arrays(arrays, names=["image_id", "y", "x", *(("v",) if alpha is None else ("b", "g", "r", "a"))])


def _with_given_alpha(out: DataFrame, pixels: DataFrame) -> DataFrame:
    return out if "a" in pixels.columns or "a" not in out.columns else out.drop("a")


def mean_filter(pixels: DataFrame, window: int = fixed.MEAN_WINDOW, tile: int = TILE, rounding: str | None = None) -> DataFrame:
    """Box mean with a mirrored border (N2, N4). The window may be of any size.

    ``rounding`` is ``down`` or ``nearest``; by default gray pixels are rounded down and colour to nearest. The job
    fails on images with missing or repeated pixels. For a window that reaches beyond the next tile the sizes of the
    images are settled now.
    """
    radius = int(window) // 2
    cells = (2 * radius + 1) ** 2
    colour = is_colour(pixels)
    channels = 3 if colour else 1
    rounding = rounding or ("nearest" if channels == 3 else "down")
    if rounding not in ("down", "nearest"):
        raise ValueError(f"unknown rounding: {rounding}")

    def rounded(sums: np.ndarray) -> np.ndarray:
        # the number of cells is odd, so a tie cannot occur
        return (2 * sums + cells) // (2 * cells) if rounding == "nearest" else sums // cells

    if radius <= tile:
        return _neighbourhoods(pixels, radius, tile, lambda part: [rounded(part.box_sums(c, radius)) for c in range(channels)])

    def make(image: int, top: int, left: int, sums: np.ndarray, own: np.ndarray | None) -> pa.RecordBatch:
        return _pixel_rows(image, top, left, list(rounded(sums)), None if own is None else (own[3], own[4]))

    packed = _packed(_tiles(pixels, tile), tile, colour)
    schema = PIXELS_BGR if colour else PIXELS
    return _with_given_alpha(summed_area.box_sums(packed, image_shapes(pixels), radius, tile, channels, colour, make, schema), pixels)


def laplacian(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """|N + S + E + W - 4C| of gray pixels, saturated at 255, with a mirrored border."""

    def edges(part: _Tile) -> list[np.ndarray]:
        wide = part.bytes[0].astype(np.int32)[part.down(1, 1)][:, part.across(1, 1)]
        cross = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]
        return [np.minimum(255, np.abs(cross - 4 * wide[1:-1, 1:-1]))]

    return _neighbourhoods(pixels, 1, tile, edges)
