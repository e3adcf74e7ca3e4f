"""Neighbourhood operators against a direct computation on arrays."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from rasterloom import schema
from rasterloom.operators import stencil, summed_area

RNG = np.random.default_rng(3)


def padded(image, radius):
    """Mirror without repeating the edge; a single row or column repeats."""

    def index(n):
        p = np.arange(-radius, n + radius)
        if n == 1:
            return np.zeros_like(p)
        p = np.mod(p, 2 * (n - 1))
        return np.where(p < n, p, 2 * (n - 1) - p)

    return image[np.ix_(index(image.shape[0]), index(image.shape[1]))]


def box(image, radius):
    wide = padded(image, radius)
    h, w = image.shape
    return sum(wide[i : i + h, j : j + w] for i in range(2 * radius + 1) for j in range(2 * radius + 1))


def test_mirrored_positions():
    assert stencil.mirrored(-2, 6, 4).tolist() == [2, 1, 0, 1, 2, 3, 2, 1]
    assert stencil.mirrored(-7, 8, 3).tolist() == [1, 2, 1, 0, 1, 2, 1, 0, 1, 2, 1, 0, 1, 2, 1]
    assert stencil.mirrored(-3, 3, None).tolist() == [3, 2, 1, 0, 1, 2]
    assert stencil.mirrored(-1, 2, 1).tolist() == [0, 0, 0]


@pytest.mark.parametrize("shape", [(40, 37), (16, 33), (17, 16), (5, 48), (1, 20), (20, 1), (1, 1), (2, 2), (3, 18)])
@pytest.mark.parametrize("radius", [1, 3])
def test_mean_filter(gray, raster, shape, radius):
    images = {0: RNG.integers(0, 256, shape), 5: RNG.integers(0, 256, (9, 11))}
    out = stencil.mean_filter(gray(images), 2 * radius + 1, tile=16)
    for i, image in images.items():
        assert (raster(out, i) == box(image, radius) // (2 * radius + 1) ** 2).all()


def test_large_window(gray, raster):
    image = RNG.integers(0, 256, (50, 45))
    assert (raster(stencil.mean_filter(gray({0: image}), 31, tile=32)) == box(image, 15) // 961).all()


def test_constant_image(gray, raster):
    flat = gray({0: np.full((10, 10), 100)})
    assert (raster(stencil.mean_filter(flat, 3)) == 100).all()
    assert (raster(stencil.laplacian(flat)) == 0).all()


def test_colour_mean_rounds_and_keeps_alpha(spark, raster):
    image = RNG.integers(0, 256, (20, 23, 4))
    rows = [(0, int(y), int(x), *map(int, image[y, x])) for y in range(20) for x in range(23)]
    out = stencil.mean_filter(spark.createDataFrame(rows, schema.PIXELS_BGR), 5, tile=8)
    for i, band in enumerate("bgr"):
        assert (raster(out, value=band) == np.rint(box(image[:, :, i], 2) / 25)).all()
    assert (raster(out, value="a") == image[:, :, 3]).all()


@pytest.mark.parametrize("shape", [(33, 31), (16, 16), (1, 9), (2, 5)])
def test_laplacian(gray, raster, shape):
    image = RNG.integers(0, 256, shape)
    wide = padded(image, 1)
    h, w = shape
    cross = wide[:h, 1 : w + 1] + wide[2:, 1 : w + 1] + wide[1 : h + 1, :w] + wide[1 : h + 1, 2:]
    expected = np.minimum(255, np.abs(cross - 4 * image))
    assert (raster(stencil.laplacian(gray({0: image}), tile=8)) == expected).all()


@pytest.mark.parametrize("shape", [(40, 30), (7, 90)])
@pytest.mark.parametrize("window", [33, 65, 257])
def test_windows_wider_than_a_tile_and_than_the_image(gray, raster, shape, window):
    image = RNG.integers(0, 256, shape)
    assert (raster(stencil.mean_filter(gray({0: image}), window, tile=16)) == box(image, window // 2) // window**2).all()


def test_rounding(gray, raster):
    image = RNG.integers(0, 256, (20, 21))
    near = stencil.mean_filter(gray({0: image}), 3, rounding="nearest")
    assert (raster(near) == np.rint(box(image, 1) / 9)).all()
    with pytest.raises(ValueError):
        stencil.mean_filter(gray({0: image}), 3, rounding="up")


def test_colour_can_be_rounded_down_and_alpha_may_be_missing(spark, raster):
    image = RNG.integers(0, 256, (9, 8, 3))
    rows = [(0, y, x, *map(int, image[y, x]), None) for y in range(9) for x in range(8)]
    pixels = spark.createDataFrame(rows, schema.PIXELS_BGR)
    out = stencil.mean_filter(pixels, 3, rounding="down")
    assert (raster(out, value="g") == box(image[:, :, 1], 1) // 9).all()
    assert out.where("a IS NOT NULL").count() == 0
    assert "a" not in stencil.mean_filter(pixels.drop("a"), 3).columns


@pytest.mark.parametrize("gone", ["x = 3 AND y = 4", "x >= 16 AND y >= 16", "x = 39 AND y = 39"])
def test_missing_pixels_fail(gray, gone):
    pixels = gray({0: RNG.integers(0, 256, (40, 40))}).where(f"NOT ({gone})")
    with pytest.raises(PySparkException, match="missing or repeated"):
        stencil.mean_filter(pixels, 3, tile=16).collect()


def test_many_small_images(gray, raster):
    images = {i: RNG.integers(0, 256, (5, 4)) for i in range(40)}
    out = stencil.mean_filter(gray(images), 3).cache()
    for i, image in images.items():
        assert (raster(out, i) == box(image, 1) // 9).all()


def test_pixels_are_shuffled_once_and_packed_bytes_once(gray):
    plan = stencil.mean_filter(gray({0: [[1, 2], [3, 4]]}), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("shape", [(50, 45), (64, 16), (1, 40), (40, 1), (1, 1), (2, 3), (17, 33)])
@pytest.mark.parametrize("radius", [9, 23, 70])
def test_windows_of_many_tiles(gray, raster, shape, radius):
    images = {0: RNG.integers(0, 256, shape), 5: RNG.integers(0, 256, (9, 21))}
    out = stencil.mean_filter(gray(images), 2 * radius + 1, tile=8)
    for i, image in images.items():
        assert (raster(out, i) == box(image, radius) // (2 * radius + 1) ** 2).all()


def test_wide_colour_mean_keeps_alpha(spark, raster):
    image = RNG.integers(0, 256, (20, 23, 4))
    rows = [(1, y, x, *map(int, image[y, x, :3]), int(image[y, x, 3]) if x % 2 else None) for y in range(20) for x in range(23)]
    near = stencil.mean_filter(spark.createDataFrame(rows, schema.PIXELS_BGR), 25, tile=64)
    wide = stencil.mean_filter(spark.createDataFrame(rows, schema.PIXELS_BGR), 25, tile=4)
    assert wide.columns == near.columns
    assert sorted(wide.collect(), key=lambda r: r[:3]) == sorted(near.collect(), key=lambda r: r[:3])


def test_a_tile_is_made_from_few_parts_whatever_the_window():
    for radius in (300, 1024, 20_000):
        asked = summed_area._askers(100_000, radius, 256)
        parts = [at for source in asked for at, _, _ in source]
        assert max(parts.count(at) for at in set(parts)) <= 6
        assert sum(high - low for source in asked for _, low, high in source) <= 2.1 * 100_000 + 512 * 256


def test_wide_windows_refuse_missing_pixels(gray):
    with pytest.raises(PySparkException, match="missing or repeated pixels"):
        stencil.mean_filter(gray({0: RNG.integers(0, 256, (30, 30))}).where("NOT (y BETWEEN 8 AND 15 AND x BETWEEN 8 AND 15)"), 41, tile=8).count()
