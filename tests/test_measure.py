import random

import numpy as np
import pytest

from rasterloom import schema
from rasterloom.operators import measure


def replay(clicks):
    """Pairs of one user by walking through the clicks in order."""
    pairs, pending = [], None
    for event, image, x, y in clicks:
        if pending and pending[0] == image:
            pairs.append((event, image, pending[1], pending[2], x, y))
            pending = None
        else:
            pending = (image, x, y)
    return pairs


@pytest.mark.parametrize("bucket", [3, 17, 100_000])
def test_pairs_equal_a_replay(spark, bucket):
    """Stretches of 3 ids cut most runs; user 0 holds most of the clicks."""
    rng = random.Random(bucket)
    rows = []
    for event in range(1500):
        user = 0 if rng.random() < 0.6 else rng.randrange(1, 8)
        image = 0 if user == 3 else rng.choice([0, 0, 0, 1, 2])
        rows.append((user, event, image, rng.randrange(50), rng.randrange(50)))
    frame = spark.createDataFrame(rows, "user_id BIGINT, event_id BIGINT, image_id BIGINT, x INT, y INT")
    got = measure.pair_clicks(frame, bucket).collect()
    expected = {
        (user, *pair)
        for user in range(8)
        for pair in replay([row[1:] for row in rows if row[0] == user])
    }
    found = {(r.user_id, r.event_id, r.image_id, r.x1, r.y1, r.x2, r.y2) for r in got}
    assert found == expected and len(got) == len(expected)


def test_sparse_ids_are_cut_by_count(spark, monkeypatch):
    """Ids like clock values: stretches of equal width would hold one click each."""
    rows = [(0, 10**15 + 7_919_000_000 * i, 0, i % 50, 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "user_id BIGINT, event_id BIGINT, image_id BIGINT, x INT, y INT")
    cuts = measure._stretch_cuts(frame, 50)
    assert len(cuts) == 5 and measure.pair_clicks(frame, 50).count() == 150
    monkeypatch.setattr(measure, "STRETCHES", 3)
    assert len(measure._stretch_cuts(frame, 50)) == 2
    assert measure.pair_clicks(frame.limit(0)).count() == 0


def test_clicks_without_user_or_id_are_left_out(spark):
    rows = [(1, 1, 0, 0, 0), (None, 2, 0, 1, 1), (1, None, 0, 2, 2), (1, 3, 0, 3, 3)]
    frame = spark.createDataFrame(rows, "user_id BIGINT, event_id BIGINT, image_id BIGINT, x INT, y INT")
    assert [(r.x1, r.x2) for r in measure.pair_clicks(frame).collect()] == [(0, 3)]


def test_bounds(spark):
    points = spark.createDataFrame(
        [(0, 0, 0), (0, 3, 1), (0, 4, 1), (0, -1, 0), (0, 2, 2), (9, 0, 0)], "image_id BIGINT, x INT, y INT"
    )
    images = spark.createDataFrame([(0, 2, 4)], "image_id BIGINT, height INT, width INT")
    assert {(r.x, r.y) for r in measure.in_bounds(points, images).collect()} == {(0, 0), (3, 1)}


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_inspection(gray, spark, broadcast_bytes):
    image = np.arange(12).reshape(3, 4)
    asked = [(0, 1, 2)] * 50 + [(0, 3, 0), (0, 4, 0), (0, 0, -1), (7, 0, 0)]
    points = spark.createDataFrame(asked, "image_id BIGINT, x INT, y INT")
    texts = [r.text for r in measure.inspect(points, gray({0: image}), broadcast_bytes).collect()]
    assert sorted(texts) == sorted(["x: 1, y: 2, value: 9"] * 50 + ["x: 3, y: 0, value: 3"] + ["x: -, y: -, value: -"] * 3)


def test_inspection_of_colour(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 1, 2, 3, 4), (0, 0, 1, 5, 6, 7, None)], schema.PIXELS_BGR)
    points = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "image_id BIGINT, x INT, y INT")
    texts = {r.x: r.text for r in measure.inspect(points, pixels).collect()}
    assert texts == {0: "x: 0, y: 0, value: BGRA(1, 2, 3, 4)", 1: "x: 1, y: 0, value: BGR(5, 6, 7)"}
    bgr = {r.x: r.text for r in measure.inspect(points, pixels.drop("a")).collect()}
    assert bgr[0] == "x: 0, y: 0, value: BGR(1, 2, 3)"
