"""Pointwise operators: hand vectors and simple properties."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom import schema
from rasterloom.functions import colour, geo, pixel
from rasterloom.operators import pixels as px

ROW = {0: [[0, 100, 255]]}


@pytest.mark.parametrize(
    "change, expected",
    [
        (px.negative, [255, 155, 0]),
        (lambda p: px.brightness(p, 50), [50, 150, 255]),
        (lambda p: px.brightness(p, -120), [0, 0, 135]),
        (lambda p: px.brightness(p), [0, 100, 255]),
        (lambda p: px.threshold(p, 127), [0, 0, 255]),
        (lambda p: px.threshold(p, 100), [0, 0, 255]),
        (lambda p: px.negative(px.negative(p)), [0, 100, 255]),
        (px.to_grayscale, [0, 100, 255]),
    ],
)
def test_gray(gray, raster, change, expected):
    assert raster(change(gray(ROW))).tolist() == [expected]


@pytest.fixture(scope="module")
def colour_row(spark):
    rows = [(0, 0, 0, 255, 0, 0, 7), (0, 0, 1, 0, 255, 0, 8), (0, 0, 2, 0, 0, 255, None), (0, 0, 3, 90, 90, 90, 0)]
    return spark.createDataFrame(rows, schema.PIXELS_BGR)


def test_colour_keeps_alpha(colour_row):
    out = px.threshold(px.brightness(px.negative(colour_row), 10), 200).orderBy("x").collect()
    assert [r.a for r in out] == [7, 8, None, 0]
    assert [(r.b, r.g, r.r) for r in out][:2] == [(0, 255, 255), (255, 0, 255)]


def test_luminance(colour_row):
    assert [r.v for r in px.to_grayscale(colour_row).orderBy("x").collect()] == [29, 150, 76, 90]


def test_colour_limits(colour_row):
    with pytest.raises(ValueError):
        px.brightness(colour_row, 256)
    with pytest.raises(ValueError):
        px.threshold(colour_row, -1)


def test_channel_order_and_split(colour_row):
    assert px.reorder_rgb(colour_row).columns == ["image_id", "y", "x", "r", "g", "b", "a"]
    bands = px.split_channels(colour_row, ("red", "luminance")).where("x = 2").collect()
    assert {(r.band, r.v) for r in bands} == {("red", 255), ("luminance", 76)}


def test_composite(spark):
    rows = [(0, 0, 0, 0.1, 0.2, 0.4), (0, 0, 1, 0.0, 0.5, -0.1)]
    out = px.true_colour(spark.createDataFrame(rows, "image_id BIGINT, y INT, x INT, b02 DOUBLE, b03 DOUBLE, b04 DOUBLE"))
    assert [(r.b, r.g, r.r) for r in out.orderBy("x").collect()] == [(64, 128, 255), (0, 255, 0)]


def test_rounding_and_clamping(spark):
    row = spark.range(1).select(
        *[pixel.round_half_away(F.lit(v)).alias(str(i)) for i, v in enumerate((2.5, -2.5, 0.49, -0.5))],
        pixel.clamp_int(F.lit(7), 9, 3).alias("low_wins"),
    )
    assert row.first()[:] == (3, -3, 0, -1, 9)


def test_values_outside_a_byte_are_refused(gray):
    assert schema.checked_pixels(gray(ROW)).count() == 3
    with pytest.raises(PySparkException, match="outside 0..255"):
        schema.checked_pixels(gray({0: [[256]]})).collect()


def test_sparse_images_are_found(gray):
    pixels = gray({0: [[1, 2], [3, 4]], 1: [[1, 2], [3, 4]]}).where("NOT (image_id = 1 AND x = 0 AND y = 0)")
    assert [r.image_id for r in schema.sparse_images(pixels).collect()] == [1]


def test_default_ranges_names_and_colours():
    assert colour.equal_ranges(5) == [(0, 50), (51, 101), (102, 152), (153, 203), (204, 255)]
    assert colour.default_ranges(6) == [(0, 69), (70, 85), (86, 130), (131, 145), (146, 216), (217, 255)]
    assert colour.default_names(6).count("Buildings / Rooftops") == 2
    assert colour.default_names(12)[-3:] == ["Other"] * 3
    assert colour.default_colours(5)[0] == (220, 64, 64)
    for hue, brightest in ((0, 0), (120, 1), (240, 2)):
        rgb = colour.hsv_to_rgb(hue, 180, 220)
        assert rgb[brightest] == 220 and sorted(rgb)[0] == 64


def test_distance(spark):
    points = [(0, 0, 3, 4), (1165, 804, 1221, 950), (None, None, 3, None)]
    frame = spark.createDataFrame(points, "x1 INT, y1 INT, x2 INT, y2 INT")
    found = [r[0] for r in frame.select(geo.pixel_distance(*map(F.col, frame.columns))).collect()]
    assert found[0] == 5.0 and round(found[1], 3) == 156.371 and found[2] == 3.0
    unit = geo.in_unit(F.lit(156.3714), F.lit("cm"), F.lit(10))
    assert spark.range(1).select(unit).first()[0] == 156.371 / 10
    with pytest.raises(PySparkException, match="out of bounds"):
        spark.range(1).select(geo.in_unit(F.lit(1.0), F.lit("cm"), F.lit(0))).collect()
    with pytest.raises(PySparkException, match="unknown unit: miles"):
        spark.range(1).select(geo.in_unit(F.lit(1.0), F.lit("miles"), F.lit(1))).collect()
