import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom.functions.colour import default_colours, default_ranges, equal_ranges
from rasterloom.operators import classify, cluster, histogram

RNG = np.random.default_rng(11)
IMAGES = {
    0: RNG.integers(0, 256, (50, 50)),
    1: np.clip(RNG.normal(90, 20, (30, 40)), 0, 255).astype(int),
    2: np.full((4, 4), 77),
    3: np.array([[0, 255, 255, 0]]),
}


def test_default_ranges_and_colours():
    assert equal_ranges(5) == [(0, 50), (51, 101), (102, 152), (153, 203), (204, 255)]
    assert default_ranges(6) == [(0, 69), (70, 85), (86, 130), (131, 145), (146, 216), (217, 255)]
    assert default_ranges(4) == [(0, 63), (64, 127), (128, 191), (192, 255)]
    assert default_colours(6)[3] == (100, 200, 0)


def lloyd(image, ranges, max_iter=30):
    """Lloyd's algorithm over every pixel."""
    pixels = np.asarray(image, float).ravel()
    c = np.array([(lo + hi) / 2 for lo, hi in ranges])
    for step in range(1, max_iter + 1):
        label = np.abs(pixels[:, None] - c).argmin(1)
        new = np.array([pixels[label == j].sum() / (label == j).sum() if (label == j).any() else c[j] for j in range(len(c))])
        done = np.abs(new - c).max() < 0.5
        c = new
        if done:
            return np.sort(c), step, True
    return np.sort(c), max_iter, False


@pytest.mark.parametrize("k", [2, 5, 6, 20])
def test_equals_a_pass_over_pixels(gray, k):
    model = cluster.kmeans(gray(IMAGES), k).collect()
    assert len(model) == len(IMAGES)
    for row in model:
        centroids, iterations, converged = lloyd(IMAGES[row.image_id], equal_ranges(k))
        assert row.centroids == centroids.tolist()
        assert (row.iterations, row.converged) == (iterations, converged)
        lo = [0] + [int(m) + 1 for m in (centroids[:-1] + centroids[1:]) / 2]
        hi = [int(m) for m in (centroids[:-1] + centroids[1:]) / 2] + [255]
        assert [(r.lo, r.hi) for r in row.ranges] == list(zip(lo, hi))
        image = IMAGES[row.image_id]
        assert row.members == [int(((image >= a) & (image <= b)).sum()) for a, b in zip(lo, hi)]


def test_no_iterations(gray):
    row = cluster.run_table(cluster.kmeans(gray({0: IMAGES[0]}), 5, max_iter=0)).first()
    assert (row.iterations, row.converged) == (0, False)
    first = cluster.centroid_table(cluster.kmeans(gray({0: IMAGES[0]}), 5, max_iter=0)).orderBy("cluster").collect()
    assert [r.centroid for r in first] == [(lo + hi) / 2 for lo, hi in equal_ranges(5)]


def test_order_and_other_images_do_not_matter(gray):
    alone = cluster.kmeans(gray({1: IMAGES[1]}), 6).drop("counts").first()
    shuffled = cluster.kmeans(gray(IMAGES).orderBy(F.rand(1)), 6).where("image_id = 1").drop("counts").first()
    assert alone == shuffled


def test_ranges_per_image(gray, spark):
    edited = [(i, c, lo, hi) for i in IMAGES if i != 1 for c, (lo, hi) in enumerate(default_ranges(6))]
    table = spark.createDataFrame(edited, "image_id BIGINT, cluster INT, lo INT, hi INT")
    for row in cluster.kmeans(gray(IMAGES), 6, ranges=table).collect():
        start = equal_ranges(6) if row.image_id == 1 else default_ranges(6)
        assert row.centroids == lloyd(IMAGES[row.image_id], start)[0].tolist()


def test_wrong_number_of_ranges(gray, spark):
    with pytest.raises(ValueError):
        cluster.kmeans(gray(IMAGES), 5, ranges=equal_ranges(6))
    short = spark.createDataFrame([(0, 0, 0, 99)], "image_id BIGINT, cluster INT, lo INT, hi INT")
    with pytest.raises(PySparkException, match="expected 5 ranges"):
        cluster.kmeans(gray(IMAGES), 5, ranges=short).collect()


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_labels(gray, raster, broadcast_bytes):
    """With the lookup broadcast, and with the shuffle join that splits off heavy images."""
    pixels = gray(IMAGES)
    model = cluster.kmeans(pixels, 5)
    out = cluster.with_cluster(pixels, model, broadcast_bytes)
    for row in model.collect():
        image = IMAGES[row.image_id]
        expected = np.zeros_like(image)
        for r in row.ranges:
            expected[(image >= r.lo) & (image <= r.hi)] = r.cluster
        assert (raster(out, row.image_id, "cluster") == expected).all()


def test_nearest_ties_go_to_the_lower_cluster(spark):
    lookup = spark.range(1).select(cluster.nearest_lookup(F.array(F.lit(10.0), F.lit(20.0)))).first()[0]
    assert lookup[15] == 0 and lookup[16] == 1 and len(lookup) == 256


def paint(image, ranges, colours):
    out = np.zeros((*image.shape, 3), int)
    for (lo, hi), (r, g, b) in zip(ranges, colours):
        out[(image >= lo) & (image <= hi)] = (b, g, r)
    return out


OVERLAP = [(0, 120), (100, 140), (130, 135), (200, 190), (180, 250)]


@pytest.mark.parametrize("as_table, broadcast_bytes", [(False, None), (True, None), (True, 0)])
def test_recolour_with_overlaps_and_gaps(gray, raster, spark, as_table, broadcast_bytes):
    image, colours = IMAGES[0], default_colours(5)
    ranges = OVERLAP
    if as_table:
        rows = [(0, c, lo, hi) for c, (lo, hi) in enumerate(OVERLAP)]
        ranges = spark.createDataFrame(rows, "image_id BIGINT, cluster INT, lo INT, hi INT")
    out = classify.recolour(gray({0: image}), ranges, 5, broadcast_bytes=broadcast_bytes)
    expected = paint(image, OVERLAP, colours)
    for i, band in enumerate("bgr"):
        assert (raster(out, value=band) == expected[:, :, i]).all()


def test_range_counts_flag_inverted_ranges(gray):
    rows = classify.range_counts(histogram.image_counts(gray({0: IMAGES[0]})), OVERLAP).orderBy("cluster").collect()
    assert [r.invalid for r in rows] == [False, False, False, True, False]
    assert rows[3].n == 0 and rows[3].share == 0
    assert [r.n for r in rows][:2] == [int((IMAGES[0] <= 120).sum()), int(((IMAGES[0] >= 100) & (IMAGES[0] <= 140)).sum())]


def test_edited_bounds_move_one_neighbour(spark):
    table = lambda rows: spark.createDataFrame(rows, "image_id BIGINT, cluster INT, lo INT, hi INT")
    preset = [(i, c, lo, hi) for i in (0, 1, 2) for c, (lo, hi) in enumerate(default_ranges(6))]
    edits = spark.createDataFrame(
        [(0, 1, "hi", 90), (1, 2, "lo", 80), (2, 5, "hi", 250)], "image_id BIGINT, cluster INT, side STRING, value INT"
    )
    out = {(r.image_id, r.cluster): (r.lo, r.hi) for r in classify.edit_bounds(table(preset), edits).collect()}
    assert out[0, 1] == (70, 90) and out[0, 2] == (91, 130) and out[0, 3] == (131, 145)
    assert out[1, 2] == (80, 130) and out[1, 1] == (70, 79) and out[1, 0] == (0, 69)
    assert out[2, 5] == (217, 250) and out[2, 4] == (146, 216)


def test_legend_keeps_equal_names_apart(gray):
    legend = classify.legend(histogram.image_counts(gray({0: IMAGES[0]})), 6).orderBy("cluster").collect()
    assert all(r.text == f"{r.name}-{100 * r.n / 2500:.1f}%" for r in legend)
    assert [r.name for r in legend].count("Buildings / Rooftops") == 2
    assert sum(r.n for r in legend) == IMAGES[0].size and abs(sum(r.share for r in legend) - 100) < 1e-9
    assert (legend[1].r, legend[1].g, legend[1].b) == (0, 180, 0)


def test_land_cover_by_range_source(gray, raster):
    pixels = gray(IMAGES)
    model = cluster.kmeans(pixels, 6)
    picture, preset = classify.land_cover(pixels, model, 6)
    _, found = classify.land_cover(pixels, model, 6, "kmeans")
    image = IMAGES[1]
    counts = {r.cluster: r.n for r in found.where("image_id = 1").collect()}
    labels = raster(picture, 1, "cluster")
    assert counts == {c: int((labels == c).sum()) for c in range(6)}
    assert [r.n for r in preset.where("image_id = 1").orderBy("cluster").collect()] == [
        int(((image >= lo) & (image <= hi)).sum()) for lo, hi in default_ranges(6)
    ]
    with pytest.raises(KeyError):
        classify.land_cover(pixels, model, 6, "other")


def test_percent_rounds_the_binary_number(spark):
    """As text shows it, ties of the decimal spelling included."""
    rows = [(t, n) for t in (400, 1000, 1600, 2000) for n in range(t + 1)]
    shown = classify._shares(spark.createDataFrame([(0, 0, 0, 0, n, t) for t, n in rows], "image_id INT, cluster INT, lo INT, hi INT, n INT, total INT"))
    for r in shown.collect():
        assert r.percent == round(r.share, 1)
    assert {r.percent for r in shown.where("n = 1").collect()} >= {0.1}


def test_the_models_legend_needs_no_join(gray):
    model = cluster.kmeans(gray(IMAGES), 6)
    legend = classify.model_legend(model, 6)
    plan = legend._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "rangepartitioning" not in plan
    found = {(r.image_id, r.cluster): r.n for r in legend.collect()}
    assert found == {(r.image_id, r.cluster): r.n for r in cluster.member_table(model).collect()}


def test_more_clusters_than_a_byte_has_signed_values(gray, raster):
    image = np.arange(256).reshape(16, 16)
    model = cluster.kmeans(gray({0: image}), 150)
    out = raster(cluster.with_cluster(gray({0: image}), model), value="cluster")
    assert out.max() == 149 and (np.diff(out.ravel()) >= 0).all()
