import numpy as np
import pytest

from rasterloom.operators import histogram

RNG = np.random.default_rng(5)
IMAGE = RNG.integers(0, 256, (30, 20))


def counts_of(image):
    return np.bincount(np.asarray(image).ravel(), minlength=256)


def test_exact(gray):
    rows = histogram.exact_histogram(gray({0: IMAGE, 1: [[3, 3]]})).orderBy("image_id", "v").collect()
    assert [r.n for r in rows[:256]] == counts_of(IMAGE).tolist()
    assert [r.n for r in rows[256:]] == counts_of([[3, 3]]).tolist()


@pytest.mark.parametrize("bins", [16, 37, 100, 255, 256])
@pytest.mark.parametrize("density, cumulative", [(False, False), (True, False), (False, True), (True, True)])
def test_rebin(gray, bins, density, cumulative):
    edges = np.linspace(0, 256, bins + 1)
    below = np.concatenate([[0], np.cumsum(counts_of(IMAGE))])
    mass = np.diff(np.interp(edges, np.arange(257), below))
    if density:
        mass = mass / (mass.sum() * 256 / bins)
    elif not cumulative:
        mass = mass / (256 / bins)
    if cumulative:
        mass = np.cumsum(mass)
    got = histogram.plot_table(gray({0: IMAGE}), bins=bins, density=density, cumulative=cumulative).orderBy("bin").toPandas()
    assert np.allclose(got.mass, mass, rtol=1e-12) and np.allclose(got.lo, edges[:-1]) and np.allclose(got.hi, edges[1:])
    if density and cumulative:
        assert np.isclose(got.mass.iloc[-1], bins / 256)


@pytest.mark.parametrize("radius", [0, 1, 8])
def test_smooth(gray, radius):
    counts = counts_of(IMAGE).astype(float)
    wide = np.pad(counts, radius, mode="edge")
    expected = [wide[i : i + 2 * radius + 1].mean() for i in range(256)]
    got = histogram.plot_table(gray({0: IMAGE}), smoothing=radius).orderBy("bin").toPandas()
    assert np.allclose(got.mass, expected)


def test_limits(gray):
    for bad in ({"bins": 15}, {"bins": 257}, {"smoothing": 9}):
        with pytest.raises(ValueError):
            histogram.plot_table(gray({0: [[1]]}), **bad)


def test_statistics_and_distinct_values(gray):
    pixels = gray({0: IMAGE})
    row = histogram.statistics(pixels).first()
    assert (row.min_value, row.max_value) == (IMAGE.min(), IMAGE.max())
    assert np.isclose(row["mean"], IMAGE.mean()) and np.isclose(row.std_dev, IMAGE.std())
    found = histogram.distinct_values(histogram.exact_histogram(pixels)).first()
    assert found.levels == sorted(set(IMAGE.ravel().tolist())) and found.unique_values == len(found.levels)


def test_byte_counts_include_alpha(spark):
    from rasterloom.schema import PIXELS_BGR

    rows = [(0, 0, 0, 1, 2, 3, 4), (0, 0, 1, 1, 1, 1, None)]
    counts = histogram.byte_counts(spark.createDataFrame(rows, PIXELS_BGR)).collect()
    assert {(r.v, r.n) for r in counts} == {(1, 4), (2, 1), (3, 1), (4, 1)}
