import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom import schema
from rasterloom.functions import prefix_codes
from rasterloom.operators import huffman
from rasterloom.operators.lookup import settled
from rasterloom.sources import containers

RNG = np.random.default_rng(9)
IMAGES = {
    0: RNG.integers(0, 256, (20, 20)),
    1: np.full((7, 9), 200),
    2: np.repeat(np.arange(14), 2 ** np.arange(14))[None, :],  # code lengths up to 13
    3: np.array([[0, 0, 255]]),
}


@pytest.fixture(scope="module")
def pixels(gray):
    return gray(IMAGES).cache()


@pytest.fixture(scope="module")
def books(pixels):
    return huffman.code_books(pixels).cache()


def test_codes_are_prefix_free_and_optimal_in_length(books):
    for book in books.collect():
        codes = [c for c in book.codes if c is not None]
        assert not any(a != b and b.startswith(a) for a in codes for b in codes) and len(set(codes)) == len(codes)
        n = np.array([n for n in book.counts if n > 0])
        bits = sum(n * np.array([len(c) for c in codes]))
        p = n / n.sum()
        if len(n) > 1:
            assert abs(sum(2.0 ** -len(c) for c in codes) - 1) < 1e-12
            assert -(n * np.log2(p)).sum() <= bits < -(n * np.log2(p)).sum() + n.sum()


def test_single_value_and_tie_order(books):
    codes = {(r.image_id, r.v): r.code for r in huffman.code_table(books).where("image_id IN (1, 3)").collect()}
    assert codes == {(1, 200): "0", (3, 0): "1", (3, 255): "0"}


def test_sizes(books):
    report = {r.image_id: r for r in huffman.sizes(books, colour=False).collect()}
    assert (report[1].payload_bits, report[1].original_bytes, report[1].unique_values) == (63, 63, 1)
    assert report[1].compressed_bytes == 16 + 1024 + 8
    colour = {r.image_id: r for r in huffman.sizes(books, colour=True).collect()}
    assert colour[1].compressed_bytes == 24 + 1024 + 8


@pytest.mark.parametrize("segment", [1, 7, 64, 4096])
def test_round_trip(pixels, books, segment):
    if segment == 1:
        pixels, books = pixels.where("image_id = 0"), books.where("image_id = 0")
    coded = huffman.encode(pixels, books, segment=segment)
    assert coded.agg(F.max("n_values")).first()[0] <= segment
    assert huffman.differing_pixels(pixels, huffman.decode(coded, books)).count() == 0


def test_packing(pixels, books):
    row = huffman.encode(pixels.where("image_id = 3"), books).first()
    assert (row.payload_bits, bytes(row.payload)) == (3, b"\xc0")


@pytest.mark.parametrize("channels", [3, 4])
def test_colour_round_trip(spark, channels):
    image = RNG.integers(0, 40, (11, 13, 4))
    rows = [(4, int(y), int(x), *map(int, image[y, x])) for y in range(11) for x in range(13)]
    pixels = spark.createDataFrame(rows, schema.PIXELS_BGR)
    pixels = pixels if channels == 4 else pixels.drop("a")
    books = huffman.code_books(pixels)
    back = huffman.decode(huffman.encode(pixels, books, segment=10), books, colour=True)
    assert huffman.differing_pixels(pixels, back).count() == 0
    assert channels == 4 or back.where("a IS NOT NULL").count() == 0


def test_a_fleet_of_images_with_and_without_alpha(spark):
    rows = [(i, y, x, i, y, x, 7 * x if i % 2 else None) for i in range(6) for y in range(5) for x in range(7)]
    pixels = spark.createDataFrame(rows, schema.PIXELS_BGR)
    books = settled(huffman.code_books(pixels))
    coded = huffman.encode(pixels, books, segment=16)
    assert {(r.image_id, r.channels) for r in coded.collect()} == {(i, 4 if i % 2 else 3) for i in range(6)}
    back = huffman.decode(coded, books, colour=True)
    assert back.count() == 6 * 35 and huffman.differing_pixels(pixels, back).count() == 0


def test_pixels_that_do_not_fill_an_image_fail(spark, gray):
    flat = gray({0: RNG.integers(0, 256, (6, 7))})
    rows = [(0, y, x, 1, 2, 3, 4 if x else None) for y in range(4) for x in range(5)]
    colour = spark.createDataFrame(rows, schema.PIXELS_BGR)
    cases = [
        (flat.where("NOT (x = 2 AND y = 3)"), "do not fill"),
        (flat.unionByName(flat.where("x = 1 AND y = 1")), "do not fill"),
        (flat.where("NOT (x = 2 AND y = 3)").unionByName(flat.where("x = 1 AND y = 1")), "missing or repeated"),
        (colour, "do not fill"),
    ]
    for pixels, message in cases:
        with pytest.raises(PySparkException, match=message):
            huffman.encode(pixels, huffman.code_books(pixels)).collect()


def test_levels_outside_a_byte_are_refused(spark):
    for level in (300, -1):
        pixels = spark.createDataFrame([(0, 0, 0, level)], "image_id BIGINT, y INT, x INT, v INT")
        with pytest.raises(PySparkException, match="outside 0..255"):
            huffman.code_books(pixels).collect()


def test_codes_longer_than_the_lookup():
    """Counts that double give one code per length, up to 40 bits."""
    codes = ["1" * i + "0" for i in range(40)] + ["1" * 40] + [None] * 215
    book = prefix_codes.Book(codes)
    rng = np.random.default_rng(4)
    parts = [np.minimum(rng.geometric(p, n), 41).astype(np.uint8) - 1 for p, n in ((0.5, 1000), (0.05, 333), (0.9, 1), (0.02, 64), (0.3, 0))]
    coded = [book.encode(p) for p in parts]
    values, begins, sound = prefix_codes.decode(*map(list, zip(*[(c[0], c[1], c[2], len(p), book) for c, p in zip(coded, parts)])))
    assert sound.all() and begins.tolist() == [0, 1000, 1333, 1334, 1398, 1398]
    assert (values == np.concatenate(parts)).all()
    assert all(prefix_codes.fault(c[0], c[1], c[2], len(p), book) is None for c, p in zip(coded, parts))
    with pytest.raises(ValueError):
        book.encode(np.array([200], np.uint8))


def test_damage_is_found(pixels, books):
    coded = huffman.encode(pixels.where("image_id = 0"), books, segment=100).where("seg = 0")
    assert huffman.damaged_segments(coded, books).count() == 0
    damages = {
        "too few values": coded.withColumn("n_values", F.col("n_values") + 1),
        "too many values": coded.withColumn("n_values", F.col("n_values") - 1),
        "corrupt payload": coded.withColumn("payload_bits", F.col("payload_bits") - 1),
        "zero dimensions": coded.withColumn("width", F.lit(0)),
        "payload length differs": coded.withColumn("payload", F.unhex(F.lit("00"))),
        "no code book": coded.withColumn("image_id", F.lit(99).cast("long")),
        "marks differ": coded.withColumn("marks", F.array(F.lit(0), F.lit(1))),
    }
    for problem, broken in damages.items():
        assert [r.problem for r in huffman.damaged_segments(broken, books).collect()] == [problem]
    with pytest.raises(PySparkException, match="too few values"):
        huffman.decode(damages["too few values"], books).collect()


def container(magic, head, counts, payload):
    return magic + struct.pack(f"<{len(head)}I", *head) + struct.pack("<256I", *counts) + payload


def test_audit_of_files(spark, tmp_path):
    counts = [0] * 256
    counts[7] = 12
    files = {
        "gray": container(b"GCH1", (3, 4, 12), counts, b"\0\0"),
        "colour": container(b"GCH2", (2, 2, 3, 12, 1), counts, b"\0\0"),
        "magic": container(b"XXXX", (3, 4, 12), counts, b"\0\0"),
        "empty": b"",
        "cut": container(b"GCH1", (3, 4, 12), counts, b"")[:500],
        "zero": container(b"GCH1", (0, 4, 12), counts, b"\0\0"),
        "sum": container(b"GCH1", (3, 5, 12), counts, b"\0\0"),
        "short": container(b"GCH1", (3, 4, 12), counts, b"\0"),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.gch").write_bytes(content)
    rows = huffman.audit(containers.read_containers(spark, str(tmp_path))).collect()
    found = {r.path.rsplit("/", 1)[1].split(".")[0]: r for r in rows}
    assert {name: row.problem for name, row in found.items()} == {
        "gray": None,
        "colour": None,
        "magic": "bad magic",
        "empty": "bad magic",
        "cut": "truncated header",
        "zero": "zero dimensions",
        "sum": "counts differ from dimensions",
        "short": "payload length differs",
    }
    colour = found["colour"]
    assert (colour.rows, colour.cols, colour.channels, colour.payload_bits, colour.version) == (2, 2, 3, 12, 1)
    assert (found["gray"].rows, found["gray"].cols, found["gray"].channels, found["gray"].version) == (3, 4, 1, None)


BOXES = [(0, 3, 5, 9, 11), (0, 8, 10, 30, 40), (0, 9, 13, 9, 14), (0, 9, 0, 9, 1), (0, 3, 5, 9, 11), (1, -5, -5, 0, 2), (1, 6, 8, 6, 8), (2, 0, 100, 0, 300), (2, 0, 200, 0, 201), (3, 1, 0, 5, 5), (3, 0, 2, 0, 1), (9, 0, 0, 9, 9)]
BOX_COLUMNS = "image_id BIGINT, top INT, left INT, bottom INT, right INT"


@pytest.mark.parametrize("segment", [7, 100, 4096])
def test_boxes_of_coded_segments(spark, pixels, books, segment):
    coded = huffman.encode(pixels, books, segment=segment)
    got = huffman.decode_boxes(coded, books, spark.createDataFrame(BOXES + [(None, 0, 0, 1, 1), (0, None, 0, 1, 1)], BOX_COLUMNS))
    inside = lambda i, y, x: any(i == b[0] and b[1] <= y <= b[3] and b[2] <= x <= b[4] for b in BOXES)
    want = [(i, y, x, int(v)) for i, image in IMAGES.items() for (y, x), v in np.ndenumerate(image) if inside(i, y, x)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("channels", [3, 4])
def test_boxes_of_coded_colour(spark, channels):
    image = RNG.integers(0, 256, (21, 34, 4))
    rows = [(4, y, x, *map(int, image[y, x, :3]), int(image[y, x, 3]) if channels == 4 else None) for y in range(21) for x in range(34)]
    pixels = spark.createDataFrame(rows, schema.PIXELS_BGR)
    books = huffman.code_books(pixels)
    coded = huffman.encode(pixels, books, segment=100)
    got = huffman.decode_boxes(coded, books, spark.createDataFrame([(4, 2, 3, 11, 20)], BOX_COLUMNS), colour=True)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == [r for r in rows if 2 <= r[1] <= 11 and 3 <= r[2] <= 20]
    read = huffman.decode_points(coded, books, spark.createDataFrame([(4, 20, 33), (4, 0, 0), (4, 21, 0), (4, 0, 0)], "image_id BIGINT, y INT, x INT"), colour=True)
    read = set(map(tuple, read.collect()))
    assert {rows[0], rows[-1]} <= read <= set(rows) and len(read) < 80


def test_lanes_that_are_not_asked_for_are_not_read(spark, gray):
    image = RNG.integers(0, 256, (64, 64))
    pixels = gray({0: image})
    books = huffman.code_books(pixels)
    coded = huffman.encode(pixels, books, segment=1024)
    # segment 0 is lost, and of segment 1 all but the first of its 16 lanes
    broken = coded.withColumn(
        "payload",
        F.when(F.col("seg") == 0, F.lit(b"")).when(
            F.col("seg") == 1, F.expr("unhex(rpad(substr(hex(payload), 1, 2 * (marks[1] div 8 + 1)), 2 * length(payload), 'F'))")
        ).otherwise(F.col("payload")),
    ).where("seg != 3")
    ask = lambda *points: spark.createDataFrame([(0, y, x) for y, x in points], "image_id BIGINT, y INT, x INT")
    got = {(r.y, r.x): r.v for r in huffman.decode_points(broken, books, ask((16, 0), (16, 63), (40, 7))).collect()}
    assert got == {(y, x): image[y, x] for y in (16, 40) for x in range(64)}
    for point in ((0, 0), (17, 0)):
        with pytest.raises(PySparkException, match="payload length differs|corrupt payload"):
            huffman.decode_points(broken, books, ask(point)).collect()


def test_no_points_and_no_segments(spark, pixels, books):
    coded = huffman.encode(pixels, books)
    empty = spark.createDataFrame([], "image_id BIGINT, y INT, x INT")
    assert huffman.decode_points(coded, books, empty).count() == 0
    assert huffman.decode_boxes(coded.limit(0), books, spark.createDataFrame(BOXES, BOX_COLUMNS)).count() == 0
