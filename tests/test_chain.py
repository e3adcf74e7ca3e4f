import numpy as np
import pytest

from rasterloom.operators import chain, cluster, huffman

IMAGES = {i: np.random.default_rng(i).integers(0, 256, (12, 10)) for i in range(2)}


def notes(result, image_id=0):
    return {r.step: r.metadata for r in result.metadata.where(f"image_id = {image_id}").collect()}


def test_chain(gray, raster):
    steps = [("negative", {}), ("brightness", {"value": 20}), ("threshold", {}), ("meanfilter", {"window": 4})]
    result = chain.run_chain(gray(IMAGES), steps)
    assert notes(result) == {
        0: {"operation": "negative", "rows": "12", "cols": "10"},
        1: {"operation": "brightness", "rows": "12", "cols": "10", "value": "20"},
        2: {"operation": "threshold", "rows": "12", "cols": "10", "value": "127"},
        3: {"operation": "meanfilter", "rows": "12", "cols": "10", "window": "5"},
    }
    assert result.log == [*(f"Operation: {name}" for name, _ in steps), "Done!"]
    inverted = np.where(np.minimum(255, 275 - IMAGES[1]) > 127, 255, 0)
    assert raster(result.image, 1)[6, 5] == inverted[4:9, 3:8].sum() // 25


def test_kmeans_step(gray, raster):
    result = chain.run_chain(gray(IMAGES), [("kmeans", {"K": 1, "maxIter": 3})])
    pixels = gray(IMAGES)
    expected = cluster.with_cluster(pixels, cluster.kmeans(pixels, 2, 3))
    assert (raster(result.image) == raster(expected, value="cluster")).all()
    assert notes(result)[0]["clusters"] == "2"
    edited = chain.run_chain(gray(IMAGES), [("kmeans", {"value": 2, "ranges": "0-99,100-255"})])
    assert set(np.unique(raster(edited.image))) == {0, 1}


def test_compress_and_back(gray, raster):
    pixels = gray(IMAGES)
    result = chain.run_chain(pixels, [("huffman_compress", {})])
    found = notes(result)[0]
    assert found["original_bytes"] == "120" and int(found["payload_bits"]) > 0
    books = huffman.code_books(pixels)
    segments = huffman.encode(pixels, books, segment=50)
    back = chain.run_chain(None, [("huffman_decompress", {"segments": segments, "books": books}), ("negative", {})])
    assert (raster(back.image) == 255 - IMAGES[0]).all() and sorted(notes(back)) == [0, 1]


def test_tables_and_aliases(gray):
    result = chain.run_chain(gray(IMAGES), [("meanfilter", {}), ("statistics", {}), ("histogram", {"bins": 16}), ("compress", {})])
    assert sorted(notes(result)) == [0, 3] and sorted(result.tables) == [1, 2]
    assert result.tables[1].count() == 2 and result.tables[2].count() == 2 * 16
    assert notes(result)[3]["operation"] == "huffman_compress"


def test_distance_needs_no_image(spark):
    points = spark.createDataFrame([(0, 1165, 804, 1221, 950)], "image_id BIGINT, x1 INT, y1 INT, x2 INT, y2 INT")
    result = chain.run_chain(None, [("distance", {"points": points})])
    assert result.image is None and notes(result)[0] == {
        "operation": "distance", "x1": "1165", "y1": "804", "x2": "1221", "y2": "950", "distance": "156.371",
    }


def test_silent_and_colour_steps(spark, raster):
    rows = [(0, y, x, 10, 20, 30, 40) for y in range(4) for x in range(4)]
    pixels = spark.createDataFrame(rows, "image_id BIGINT, y INT, x INT, b INT, g INT, r INT, a INT")
    result = chain.run_chain(pixels, [("negative", {}), ("laplacian", {})])
    assert sorted(notes(result)) == [0] and (raster(result.image) == 0).all()
    assert chain.run_chain(pixels, [("grayscale", {})]).image.first().v == 22


def test_prompts_become_a_chain(gray, raster):
    texts = ["Show F-7", "make it negative", "What is this?", "measure the distance", "raise the threshold"]
    result = chain.run_prompts(gray(IMAGES), texts, {"threshold": {"value": 100}})
    assert [notes(result)[i]["operation"] for i in (0, 1)] == ["negative", "threshold"]
    assert (raster(result.image) == np.where(255 - IMAGES[0] > 100, 255, 0)).all()
    assert chain.run_prompts(gray(IMAGES), ["hello"]).log == ["Done!"]


def test_errors(gray):
    for steps, message in (
        ([("sharpen", {})], "Unsupported operation: sharpen"),
        ([("", {})], "No operation"),
    ):
        with pytest.raises(ValueError, match=message):
            chain.run_chain(gray({0: [[1]]}), steps)
    with pytest.raises(ValueError, match="requires an image"):
        chain.run_chain(None, [("negative", {})])


def test_levels_are_counted_once(gray, spark, tmp_path):
    """Behind the first count no step reads a pixel again; a step that moves pixels starts over."""
    gray(IMAGES).write.parquet(str(tmp_path / "pixels"))
    pixels = spark.read.parquet(str(tmp_path / "pixels"))
    steps = [("statistics", {}), ("negative", {}), ("brightness", {"value": 30}), ("statistics", {}), ("huffman_compress", {}), ("threshold", {}), ("histogram", {})]
    result = chain.run_chain(pixels, steps)
    for table in result.tables.values():
        assert "parquet" not in table._jdf.queryExecution().optimizedPlan().toString().lower()
    now = np.clip(285 - IMAGES[0], 0, 255)
    row = result.tables[3].where("image_id = 0").first()
    assert (row.min_value, row.max_value, row["mean"]) == (now.min(), now.max(), now.mean())
    assert abs(row.std_dev - now.std()) < 1e-9
    assert notes(result)[4]["unique_values"] == str(len(np.unique(now)))
    assert {r.v if "v" in r else r.lo: r.mass for r in result.tables[6].where("image_id = 0 AND mass > 0").collect()} == {0.0: (now <= 127).sum(), 255.0: (now > 127).sum()}
    moved = chain.run_chain(pixels, [("statistics", {}), ("meanfilter", {}), ("statistics", {})])
    again = chain.run_chain(pixels, [("meanfilter", {}), ("statistics", {})])
    assert sorted(moved.tables[2].collect()) == sorted(again.tables[1].collect())


def test_counted_levels_give_what_pixels_give(gray):
    from rasterloom.operators import histogram

    pixels = gray(IMAGES)
    levels = histogram.counted_levels(pixels)
    model, other = (cluster.kmeans(x, 4).orderBy("image_id").collect() for x in (pixels, levels))
    assert model == other
    assert huffman.code_books(levels).orderBy("image_id").collect() == huffman.code_books(pixels).orderBy("image_id").collect()
    assert histogram.exact_histogram(levels).collect() and sorted(histogram.exact_histogram(levels).collect()) == sorted(histogram.exact_histogram(pixels).collect())
