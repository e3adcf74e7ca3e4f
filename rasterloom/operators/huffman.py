"""Huffman code books, sizes, segment-wise coding and container audits (H1..H7).

A code book depends on the 256 byte counts of an image, one row per image. Pixels are coded in segments
of a fixed number of bytes, so a huge image is many independent pieces of work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rasterloom import fixed_values as fixed
from rasterloom.functions import prefix_codes
from rasterloom.functions.prefix_codes import Book
from rasterloom.operators.histogram import byte_counts, dense_counts
from rasterloom.operators.lookup import Settled, lookup_join, settled
from rasterloom.schema import LEVELS, PIXELS, PIXELS_BGR, image_shapes, is_colour

SEGMENT = 4096


def _codes(counts: np.ndarray) -> list[str | None]:
    """Code per byte value; null for values that do not occur.

    Always the two lightest groups are joined, equal weights by their lowest value; the first of the two
    gets a leading 0.
    """
    groups = [(int(n), v, [v]) for v, n in enumerate(counts) if n > 0]
    codes: list[str | None] = [None] * LEVELS
    for _, v, _ in groups:
        codes[v] = "" if len(groups) > 1 else "0"
    heapq.heapify(groups)
    while len(groups) > 1:
        (n0, low0, zeros), (n1, low1, ones) = heapq.heappop(groups), heapq.heappop(groups)
        for bit, members in (("0", zeros), ("1", ones)):
            for v in members:
                codes[v] = bit + codes[v]
        heapq.heappush(groups, (n0 + n1, min(low0, low1), zeros + ones))
    return codes


@F.pandas_udf(T.ArrayType(T.StringType()))
def _code_book(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for counts in batches:
        yield counts.map(_codes)


def code_books(pixels: DataFrame) -> DataFrame:
    """One row per image: its byte ``counts``, their ``total`` and the ``codes`` of all 256 values (H1, H2)."""
    return dense_counts(byte_counts(pixels), ["image_id"]).withColumn("codes", _code_book("counts"))


def code_table(books: DataFrame) -> DataFrame:
    """(image_id, v, n, code, code_len) of the values that occur."""
    rows = books.select("image_id", "counts", F.posexplode_outer("codes").alias("v", "code")).where("code IS NOT NULL")
    return rows.select("image_id", "v", F.get("counts", F.col("v")).alias("n"), "code", F.length("code").alias("code_len"))


def _payload_bits() -> Column:
    lengths = F.transform("codes", lambda c: F.coalesce(F.length(c), F.lit(0)))
    products = F.zip_with("counts", lengths, lambda n, bits: n * bits)
    return F.aggregate(products, F.lit(0).cast("long"), lambda a, b: a + b)


def sizes(books: DataFrame, colour: bool) -> DataFrame:
    """Original and compressed size per image (H3); the container differs for gray and colour."""
    fields = fixed.COLOUR_FIELDS if colour else fixed.GRAY_FIELDS
    header = 4 + 4 * fields + fixed.COUNT_TABLE_BYTES
    return books.select(
        "image_id",
        F.col("total").alias("original_bytes"),
        _payload_bits().alias("payload_bits"),
        F.size(F.filter("counts", lambda n: n > 0)).alias("unique_values"),
    ).withColumn("compressed_bytes", F.lit(header) + F.ceil(F.col("payload_bits") / 8))


def encode(pixels: DataFrame, books: DataFrame | Settled, images: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """(image_id, seg, height, width, channels, segment, n_values, payload_bits, marks, payload) (H4).

    A segment is ``segment`` pixels in row order, channels b, g, r[, a]. Bits are packed most significant first and
    each segment is padded with zeros to a whole byte; ``marks`` are the bits at which every 64th value begins. A
    colour image has three channels if alpha is null in all its pixels, and four if in none. The job fails on an
    image with alpha in some pixels only, and on missing or repeated pixels. Pixels are shuffled once, as one
    integer each; code books and sizes meet whole segments.
    """
    colour = is_colour(pixels)
    shapes = (image_shapes(pixels) if images is None else images).select("image_id", "height", "width")
    if colour:
        alpha = F.coalesce("a", F.lit(0)) if "a" in pixels.columns else F.lit(0)
        value = ((F.col("b") * LEVELS + F.col("g")) * LEVELS + F.col("r")).cast("long") * LEVELS + alpha
    else:
        value = F.col("v").cast("long")
    shaped = lookup_join(pixels.withColumn("_value", value).select("image_id", "y", "x", "_value"), shapes, ["image_id"], "inner")
    at = F.col("y").cast("long") * F.col("width") + F.col("x")
    inside = F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    outside = F.raise_error(F.concat(F.lit("pixel outside its image "), F.col("image_id").cast("string")))
    packed = shaped.select(
        "image_id",
        "height",
        "width",
        F.when(inside, F.floor(at / segment)).otherwise(outside.cast("long")).alias("seg"),
        # place in the segment and value, in one sortable integer
        ((at % segment) * (1 << 32) + F.col("_value")).alias("item"),
    )
    segments = packed.groupBy("image_id", "seg").agg(
        F.first("height").alias("height"), F.first("width").alias("width"), F.sort_array(F.collect_list("item")).alias("items")
    )
    books = _with_total(books)
    booked = lookup_join(segments, books, ["image_id"], "inner")
    names = ["image_id", "seg", "height", "width", "total", "codes", "items"]
    return booked.select(*names).mapInArrow(lambda it: _encoded(it, segment, colour), SEGMENTS)


SEGMENTS = (
    "image_id BIGINT, seg BIGINT, height INT, width INT, channels INT, segment INT, n_values INT, payload_bits INT,"
    " marks ARRAY<INT>, payload BINARY"
)


def _with_total(books: DataFrame | Settled) -> DataFrame | Settled:
    if isinstance(books, Settled):
        return books.select("image_id", "total", "codes")
    return books.select("image_id", "total", "codes")


def _encoded(batches: Iterator[pa.RecordBatch], segment: int, colour: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, book_of = [], {}
        for row in range(batch.num_rows):
            image, seg, height, width, total = (batch.column(c)[row].as_py() for c in ("image_id", "seg", "height", "width", "total"))
            if image not in book_of:
                book_of[image] = Book(batch.column("codes")[row].as_py())
            items = batch.column("items")[row].values.to_numpy()
            cells = height * width
            channels = total // cells if cells else 0
            if total != channels * cells or channels not in ((3, 4) if colour else (1,)):
                raise ValueError(f"image {image}: {total} values do not fill {height} x {width} pixels")
            places = items >> 32
            if not np.array_equal(places, np.arange(min(segment, cells - seg * segment))):
                raise ValueError(f"image {image}: missing or repeated pixels in segment {seg}")
            values = (items & 0xFFFFFFFF).astype(">u4").view(np.uint8).reshape(-1, 4)
            values = values[:, 3] if channels == 1 else values[:, :channels].ravel()
            payload, bits, marks = book_of[image].encode(values)
            rows.append((image, seg, height, width, channels, segment, len(values), bits, marks, payload))
        columns = list(zip(*rows)) or [[]] * 10
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["image_id", "seg", "height", "width", "channels", "segment", "n_values", "payload_bits", "marks", "payload"],
        )


_READ = ["image_id", "seg", "width", "channels", "segment", "n_values", "payload_bits", "marks", "payload", "codes"]
_TABLE_ENTRIES = 1 << 22  # entries of decoding tables that are held at once


def _booked(segments: DataFrame, books: DataFrame | Settled) -> DataFrame:
    return lookup_join(segments, _with_total(books), ["image_id"], "left").select(*_READ)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[str | None], np.ndarray, np.ndarray]]:
    """Runs of segments with their faults, all their values, and where those of each segment begin."""
    for batch in batches:
        rows: list[dict] = []
        book_of: dict[int, Book] = {}

        def flush() -> tuple[list[dict], list[str | None], np.ndarray, np.ndarray]:
            faults = [_impossible(r) for r in rows]
            read = [r if f is None else None for r, f in zip(rows, faults)]
            empty = Book([None] * LEVELS)
            values, begins, sound = prefix_codes.decode(
                [r["payload"] if r else b"" for r in read],
                [r["payload_bits"] if r else 0 for r in read],
                [r["marks"] if r else [] for r in read],
                [r["n_values"] if r else 0 for r in read],
                [book_of[r["image_id"]] if r else empty for r in read],
            )
            for i, r in enumerate(read):
                if r and not sound[i]:
                    faults[i] = prefix_codes.fault(r["payload"], r["payload_bits"], r["marks"], r["n_values"], book_of[r["image_id"]])
            return rows, faults, values, begins

        held = 0
        for row in batch.to_pylist():
            if row["codes"] is not None and row["image_id"] not in book_of:
                book_of[row["image_id"]] = Book(row["codes"])
                held += 1 << book_of[row["image_id"]].peek
            row["codes"] = row["codes"] is not None
            rows.append(row)
            if held > _TABLE_ENTRIES or len(rows) == 1024:
                yield flush()
                rows, book_of, held = [], {}, 0
        if rows:
            yield flush()


def _impossible(row: dict) -> str | None:
    if not row["codes"]:
        return "no code book"
    if row["width"] <= 0 or row["channels"] <= 0:
        return "zero dimensions"
    if len(row["payload"]) != -(-row["payload_bits"] // 8):
        return "payload length differs"
    return None


def decode(segments: DataFrame, books: DataFrame | Settled, colour: bool = False) -> DataFrame:
    """Pixels of coded segments (H5): gray, or b, g, r, a with a null alpha for images of three channels.

    A damaged segment fails the job; :func:`damaged_segments` lists them instead.
    """
    names = ["b", "g", "r", "a"] if colour else ["v"]

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, faults, values, begins in _read(batches):
            for i, row in enumerate(rows):
                if faults[i]:
                    raise ValueError(f"image {row['image_id']} segment {row['seg']}: {faults[i]}")
                bands = values[begins[i] : begins[i + 1]].reshape(-1, row["channels"]).astype(np.int32)
                at = row["seg"] * row["segment"] + np.arange(len(bands))
                y, x = np.divmod(at, row["width"])
                columns = [np.full(len(bands), row["image_id"]), y.astype(np.int32), x.astype(np.int32), *bands.T]
                arrays = [pa.array(c) for c in columns]
                if len(arrays) < 3 + len(names):
                    arrays.append(pa.nulls(len(bands), pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, names=["image_id", "y", "x", *names])

    wanted = segments.where(F.col("channels") >= 3 if colour else F.col("channels") <= 1)
    return _booked(wanted, books).mapInArrow(pixels, PIXELS_BGR if colour else PIXELS)


def decode_points(segments: DataFrame, books: DataFrame | Settled, points: DataFrame, colour: bool = False) -> DataFrame:
    """Pixels of the lanes that hold the ``points`` (image_id, y, x), and of no others.

    Points off their image have no pixel. Repeated points are one; neighbours of a point come along with it. See
    :func:`decode_boxes` for what is read and settled.
    """
    asked = points.select("image_id", "y", F.col("x").alias("left"), F.col("x").alias("right")).distinct()
    return _decoded_lanes(segments, books, asked, colour, settled(_layouts(segments)))


def decode_boxes(segments: DataFrame, books: DataFrame | Settled, boxes: DataFrame, colour: bool = False) -> DataFrame:
    """Pixels inside any of the ``boxes`` (image_id, top, left, bottom, right; edges included), each once (H5).

    Segments that no box meets are left out by a join on their key, before code books and decoding. In a segment that
    one meets, ``marks`` give the bit at which each lane of 64 values begins, and only lanes under a box are read. A
    damaged lane fails the job if it is read. A box is cut off at the edges of its image; one that is empty or has a
    null in it has no pixels. The sizes of the images, the lines under boxes and the lanes asked for are settled now.
    """
    known = boxes.where("top <= bottom AND left <= right AND bottom >= 0")
    layouts = settled(_layouts(segments))
    tall = lookup_join(known, layouts.select("image_id", "height"), ["image_id"], "inner")
    stop = F.least("bottom", F.col("height") - 1)
    lines = tall.where("top < height").withColumn("y", F.explode(F.sequence(F.greatest("top", F.lit(0)), stop)))
    # spans of a line that overlap or touch are made one, so a line has fewer of them than pixels
    along = Window.partitionBy("image_id", "y").orderBy("left", "right")
    reach = F.max("right").over(along.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.select("image_id", "y", "left", "right").distinct().withColumn("apart", F.coalesce((F.col("left") > reach + 1).cast("int"), F.lit(0)))
    lines = lines.withColumn("span", F.sum("apart").over(along)).groupBy("image_id", "y", "span")
    lines = lines.agg(F.min("left").alias("left"), F.max("right").alias("right"))
    lines = settled(lines.groupBy("image_id", "y").agg(F.collect_list(F.struct("left", "right")).alias("spans")))
    spans = lines.table.select("image_id", "y", F.explode("spans").alias("s")).select("image_id", "y", "s.*")
    read = _decoded_lanes(segments, books, spans, colour, layouts)
    met = F.exists("spans", lambda s: F.col("x").between(s["left"], s["right"]))
    return lookup_join(read, lines, ["image_id", "y"], "inner").where(met).select(*read.columns)


def _layouts(segments: DataFrame) -> DataFrame:
    """One row per image: its size, channels and pixels per segment."""
    fields = ["height", "width", "channels", "segment"]
    return segments.groupBy("image_id").agg(*[F.max(c).alias(c) for c in fields])


def _decoded_lanes(segments: DataFrame, books: DataFrame | Settled, lines: DataFrame, colour: bool, layouts: Settled) -> DataFrame:
    """Pixels of all lanes that hold a pixel left..right of a line y of an image."""
    placed = lookup_join(lines, layouts, ["image_id"], "inner")
    placed = placed.where("y BETWEEN 0 AND height - 1 AND left < width AND right >= 0 AND left <= right")
    first = F.col("y").cast("long") * F.col("width") + F.greatest("left", F.lit(0))
    last = F.col("y").cast("long") * F.col("width") + F.least("right", F.col("width") - 1)
    per = F.col("segment")
    parts = placed.select("image_id", "channels", "segment", first.alias("first"), last.alias("last"))
    parts = parts.withColumn("seg", F.explode(F.sequence(F.floor(F.col("first") / per), F.floor(F.col("last") / per))))
    low = F.greatest(F.col("first") - F.col("seg") * per, F.lit(0)) * F.col("channels")
    high = (F.least(F.col("last") - F.col("seg") * per, per - 1) + 1) * F.col("channels") - 1
    lanes = F.sequence(F.floor(low / prefix_codes.LANE), F.floor(high / prefix_codes.LANE))
    # a set holds at most the lanes of a segment, however often one is asked for
    wanted = parts.select("image_id", "seg", F.explode(lanes).alias("lane")).groupBy("image_id", "seg")
    wanted = wanted.agg(F.sort_array(F.collect_set("lane")).alias("lanes"))
    kind = F.col("channels") >= 3 if colour else F.col("channels") <= 1
    met = lookup_join(segments.where(kind), wanted, ["image_id", "seg"], "inner")
    booked = lookup_join(met, _with_total(books), ["image_id"], "left").select(*_READ, "lanes")
    names = ["b", "g", "r", "a"] if colour else ["v"]

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            book_of: dict[int, Book] = {}
            rows: list[dict] = []
            for row in batch.to_pylist():
                fault = _impossible(row)
                if fault:
                    raise ValueError(f"image {row['image_id']} segment {row['seg']}: {fault}")
                if row["image_id"] not in book_of:
                    book_of[row["image_id"]] = Book(row["codes"])
                rows.append(row)
                if len(rows) == 1024 or sum(1 << b.peek for b in book_of.values()) > _TABLE_ENTRIES:
                    yield _lane_pixels(rows, book_of, names)
                    rows, book_of = [], {}
            if rows:
                yield _lane_pixels(rows, book_of, names)

    return booked.mapInArrow(pixels, PIXELS_BGR if colour else PIXELS)


def _lane_pixels(rows: list[dict], book_of: dict[int, Book], names: list[str]) -> pa.RecordBatch:
    parts = [[r[c] for r in rows] for c in ("payload", "payload_bits", "marks", "n_values")]
    values, owner, sound = prefix_codes.decode_lanes(*parts, [book_of[r["image_id"]] for r in rows], [r["lanes"] for r in rows])
    if not sound.all():
        bad = rows[owner[~sound][0]]
        raise ValueError(f"image {bad['image_id']} segment {bad['seg']}: corrupt payload")
    columns: list[list[np.ndarray]] = [[] for _ in range(3 + len(names))]
    begins = np.searchsorted(owner, np.arange(len(rows) + 1))
    for i, row in enumerate(rows):
        channels = row["channels"]
        at = (np.asarray(row["lanes"])[:, None] * prefix_codes.LANE + np.arange(prefix_codes.LANE)).ravel()
        flat = values[begins[i] : begins[i + 1]].ravel()[at < row["n_values"]]
        at = at[at < row["n_values"]]
        # pixels all of whose channels were read: lanes are in order, so their values stand together
        heads = np.flatnonzero((at % channels == 0) & (at + channels - 1 <= at[-1]))
        heads = heads[at[heads + channels - 1] == at[heads] + channels - 1]
        y, x = np.divmod(row["seg"] * row["segment"] + at[heads] // channels, row["width"])
        columns[0].append(np.full(len(heads), row["image_id"], np.int64))
        columns[1].append(y.astype(np.int32))
        columns[2].append(x.astype(np.int32))
        for band in range(len(names)):
            columns[3 + band].append(flat[heads + band].astype(np.int32) if band < channels else np.full(len(heads), -1, np.int32))
    arrays = [np.concatenate(c) for c in columns]
    given = [pa.array(c, mask=c < 0) if name == "a" else pa.array(c) for c, name in zip(arrays, ["image_id", "y", "x", *names])]
    return pa.RecordBatch.from_arrays(given, names=["image_id", "y", "x", *names])


def damaged_segments(segments: DataFrame, books: DataFrame | Settled) -> DataFrame:
    """(image_id, seg, problem) of the segments that do not decode."""

    def problems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, faults, _, _ in _read(batches):
            bad = [(r["image_id"], r["seg"], f) for r, f in zip(rows, faults) if f]
            columns = list(zip(*bad)) or [[]] * 3
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["image_id", "seg", "problem"])

    return _booked(segments, books).mapInArrow(problems, "image_id BIGINT, seg BIGINT, problem STRING")


def differing_pixels(pixels: DataFrame, decoded: DataFrame) -> DataFrame:
    """Rows that are not equally often in both tables, with the ``surplus`` of the first (H7).

    Empty after a lossless round trip. Both tables go through one shuffle.
    """
    counted = pixels.withColumn("n", F.lit(1)).unionByName(decoded.select(*pixels.columns).withColumn("n", F.lit(-1)))
    return counted.groupBy(*pixels.columns).agg(F.sum("n").alias("surplus")).where("surplus != 0")


def audit(containers: DataFrame) -> DataFrame:
    """Header fields and faults of compressed containers (H6).

    ``containers``: (path, length, content); only the header and the count table of the content are
    looked at. ``problem`` is null for a container whose parts agree.
    """
    head = F.substring("content", 1, 4 + 4 * fixed.COLOUR_FIELDS + fixed.COUNT_TABLE_BYTES)
    words = F.regexp_extract_all(F.hex(F.substring(head, 5, 1 << 20)), F.lit(".{8}"), F.lit(0))
    little = lambda w: F.conv(
        F.concat(F.substring(w, 7, 2), F.substring(w, 5, 2), F.substring(w, 3, 2), F.substring(w, 1, 2)), 16, 10
    ).cast("long")
    magic = F.when(
        F.hex(F.substring(head, 1, 4)) == F.hex(F.lit(fixed.GRAY_MAGIC)), fixed.GRAY_MAGIC
    ).when(F.hex(F.substring(head, 1, 4)) == F.hex(F.lit(fixed.COLOUR_MAGIC)), fixed.COLOUR_MAGIC)
    parsed = containers.select("path", "length", magic.alias("magic"), F.transform(words, little).alias("u32"))
    gray = F.col("magic") == fixed.GRAY_MAGIC
    fields = F.when(gray, fixed.GRAY_FIELDS).otherwise(fixed.COLOUR_FIELDS)
    known = parsed.withColumn("fields", F.when(F.col("magic").isNotNull(), fields))
    word = lambda i: F.when(F.col("magic").isNotNull(), F.get("u32", F.lit(i)))
    named = known.select(
        "path",
        "length",
        "magic",
        word(0).alias("rows"),
        word(1).alias("cols"),
        F.when(gray, 1).otherwise(word(2)).alias("channels"),
        F.when(gray, word(2)).otherwise(word(3)).alias("payload_bits"),
        F.when(~gray, word(4)).alias("version"),
        F.size(F.slice("u32", F.col("fields") + 1, LEVELS)).alias("levels"),
        F.aggregate(
            F.slice("u32", F.col("fields") + 1, LEVELS), F.lit(0).cast("long"), lambda a, b: a + b
        ).alias("counted"),
        (4 + 4 * F.col("fields") + fixed.COUNT_TABLE_BYTES).alias("header_bytes"),
    )
    problem = (
        F.when(F.col("magic").isNull(), "bad magic")
        .when(F.col("levels") < LEVELS, "truncated header")
        .when((F.col("rows") == 0) | (F.col("cols") == 0) | (F.col("channels") == 0), "zero dimensions")
        .when(F.col("counted") != F.col("rows") * F.col("cols") * F.col("channels"), "counts differ from dimensions")
        .when(F.col("length") != F.col("header_bytes") + F.ceil(F.col("payload_bits") / 8), "payload length differs")
    )
    return named.withColumn("problem", problem).drop("levels", "header_bytes")


def container_heads(books: DataFrame, shapes: DataFrame, colour: bool, channels: int = 1) -> DataFrame:
    """(path, length, content) with the header and count table a container of each image starts with."""

    def u32(value: Column) -> Column:
        digits = F.lpad(F.hex(value.cast("long")), 8, F.lit("0"))
        return F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])

    fields = [F.col("height"), F.col("width")]
    if colour:
        fields += [F.lit(channels), F.col("payload_bits"), F.lit(1)]
    else:
        fields += [F.col("payload_bits")]
    magic = fixed.COLOUR_MAGIC if colour else fixed.GRAY_MAGIC
    rows = books.join(sizes(books, colour).select("image_id", "payload_bits", "compressed_bytes"), "image_id").join(
        shapes.select("image_id", "height", "width"), "image_id"
    )
    table = F.array_join(F.transform("counts", u32), "")
    return rows.select(
        F.concat(F.lit("image-"), F.col("image_id")).alias("path"),
        F.col("compressed_bytes").alias("length"),
        F.unhex(F.concat(F.hex(F.lit(magic)), *[u32(f) for f in fields], table)).alias("content"),
    )
